"""Partitioned Parquet output with a guard on the number of directories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from keybalance.functions.keys import column_ref

MAX_DIRECTORIES = 10_000
RECORDS_PER_FILE = 10_000_000


def write_partitioned(
    df: DataFrame,
    columns: Sequence[str],
    path: str,
    n: int | None = None,
    max_directories: int = MAX_DIRECTORIES,
    records_per_file: int = RECORDS_PER_FILE,
    mode: str = "errorifexists",
) -> None:
    """Write one directory per key, refusing columns with more distinct keys than allowed.

    An empty string is refused as well: its directory would read back as null. Read
    the folder with ``read_partitioned``, which keeps the key's type.

    The rows are rebalanced by key, from ``n`` partitions if given: adaptive
    execution splits the partition of a hot key over several writers and joins
    small ones, where a plain ``repartition(n, key)`` leaves a hot key to one task.
    """
    refs = [column_ref(c) for c in columns]
    # One pass over the key columns; the driver gets a row per directory at most.
    keys = df.select(*refs).distinct().limit(max_directories + 1).collect()
    if len(keys) > max_directories:
        raise ValueError(
            f"{list(columns)} has more distinct keys than the {max_directories} "
            "directories allowed; partition on a coarser key"
        )
    for i, name in enumerate(columns):
        if any(key[i] == "" for key in keys):
            raise ValueError(f"{name!r} holds empty strings, which no directory can tell from null")
    hint = [*([n] if n else []), *refs]
    (
        df.hint("rebalance", *hint)
        .write.mode(mode)
        .option("maxRecordsPerFile", records_per_file)
        .partitionBy(*columns)
        .parquet(path)
    )


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_partitioned`` wrote, with the types and column order of ``schema``."""
    return spark.read.schema(schema).parquet(path).select(*[column_ref(n) for n in schema.names])
