"""Table readers and the schema listing."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from keybalance.functions.keys import column_ref
from keybalance.sources.arrow_ipc import read_arrow_ipc


# A failed footer read surfaces as either, depending on where it is noticed.
_READ_ERRORS = (PySparkException, Py4JError)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str = ",",
    header: bool = True,
    **options,
) -> DataFrame:
    """CSV with a header. Give ``schema`` for large input: inferring it is a second scan."""
    reader = spark.read.option("header", header).option("sep", sep).options(**options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def load_table(spark: SparkSession, path: str, **csv_options) -> DataFrame:
    """Reader by suffix, in any case; without a known one Parquet is tried, then CSV."""
    suffix = path.lower().rstrip("/")
    if suffix.endswith(".parquet"):
        return read_parquet(spark, path)
    if suffix.endswith(".csv"):
        return read_csv(spark, path, **csv_options)
    if suffix.endswith((".arrow", ".arrows", ".feather", ".ipc")):
        return read_arrow_ipc(spark, path)
    try:
        return read_parquet(spark, path)
    except _READ_ERRORS as parquet_error:
        try:
            return read_csv(spark, path, **csv_options)
        except _READ_ERRORS as csv_error:
            raise ValueError(
                f"could not read {path} as Parquet ({parquet_error}) or CSV ({csv_error})"
            ) from csv_error


#: Sizes from here on stand for "not known" in a plan.
_UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that ``df`` comes from, by Spark's plan; None where it does not know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= _UNKNOWN for s in sizes) else sum(sizes)


def footer_counts(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(column, total_rows, null_count, null_fraction) of Parquet files from their footers.

    Counts are pushed down to Spark's Parquet reader (version 2), so no column is read. That
    takes settings that hold while the query is planned, so the one row of counts is taken here. Columns of
    nested types have no counts in a footer and are an error.
    """
    settings = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        counted = _counts(spark.read.parquet(path), columns)
        row = counted.first()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    total, *held = (n or 0 for n in row)  # without any row group there is no count
    rows = [(c, total, total - n) for c, n in zip(columns, held)]
    out = spark.createDataFrame(rows, "column string, total_rows bigint, null_count bigint")
    share = F.col("null_count") / F.col("total_rows")
    return out.withColumn("null_fraction", F.when(F.col("total_rows") > 0, share).otherwise(F.lit(0.0)))


def _counts(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, and values that are not null of each column."""
    for name in columns:
        if isinstance(table.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"column {name!r} is nested: a footer has no count of it")
    counts = [F.count(column_ref(c)).alias(f"c{i}") for i, c in enumerate(columns)]
    return table.agg(F.count(F.lit(1)).alias("total"), *counts)


def schema_info(df: DataFrame) -> dict[str, str]:
    """Column name -> type name."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}
