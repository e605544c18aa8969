"""Exact heavy keys without shuffling the key set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keybalance.functions.keys import column_ref

_MIN_BUCKETS = 1 << 16


def hash_bucket(columns: Sequence[str], n: int) -> Column:
    """The partition 0..n-1 that ``repartition(n, *columns)`` sends a row to.

    A hash is never null. Saying so keeps null filters from being added on it, which
    would tell apart the scans that different users of the buckets could share.
    """
    bucket = F.pmod(F.hash(*[column_ref(c) for c in columns]), F.lit(n))
    return F.coalesce(bucket, F.lit(0)).cast("int")


def bucket_number(parts: int, multiple_of: int = 1) -> int:
    """How many buckets make an average one far lighter than a heavy key."""
    return multiple_of * -(-max(_MIN_BUCKETS, 8 * parts) // multiple_of)


def bucket_counts(df: DataFrame, columns: Sequence[str], buckets: int) -> DataFrame:
    """(bucket, n, total): rows per hash bucket, and in all.

    The shuffle carries at most one small row per bucket and task. The total is a
    window over the bucket rows, whose number does not grow with the data.
    """
    counts = df.groupBy(hash_bucket(columns, buckets).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def heavy_keys(
    df: DataFrame,
    columns: Sequence[str],
    parts: int,
    buckets: int | None = None,
) -> DataFrame:
    """Keys with more than 1/``parts`` of all rows: (*columns, n, total).

    Exact, in two light passes: a key cannot be heavier than its hash bucket, so
    only rows of heavy buckets (fewer than ``parts`` of them, hence broadcast) are
    counted by key. Null is a key. Fewer than ``parts`` rows come out.
    """
    if parts < 1:
        raise ValueError("parts must be >= 1")
    buckets = buckets or bucket_number(parts)
    suspects = (
        bucket_counts(df, columns, buckets)
        .where(F.col("n") * parts > F.col("total"))
        .select(F.col("bucket").alias("__bucket"), F.col("total").alias("__total"))
    )
    refs = [column_ref(c) for c in columns]
    return (
        df.select(*refs, hash_bucket(columns, buckets).alias("__bucket"))
        .join(F.broadcast(suspects), "__bucket")
        .groupBy(*refs)
        .agg(F.count(F.lit(1)).alias("n"), F.max("__total").alias("total"))
        .where(F.col("n") * parts > F.col("total"))
    )
