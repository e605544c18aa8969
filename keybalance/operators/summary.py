"""Heavy hitters in bounded space: a mergeable summary with a known error.

A summary keeps at most ``cap`` counters per column. Where there are more keys, the count of the
largest one beyond the cap is taken off all counters, and those that reach zero go. Every such
cut takes as much from at least cap + 1 keys, so all cuts of a column together are at most
rows / (cap + 1), and so is what any count can have lost, also for keys that are not held.
Summaries of parts of a table merge into one of the whole with the same bound.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from keybalance.functions.keys import Candidate, parse_candidates
from keybalance.operators.frequency import key_frequency, top_keys

#: Counters per column.
CAP = 500


def check_cap(cap: int) -> int:
    if cap < 1:
        raise ValueError(f"a summary needs at least one counter, got {cap}")
    return cap


def leading(counts: DataFrame, cap: int = CAP) -> DataFrame:
    """(column, key, n, rank, cut): the first cap + 1 keys per column, and what is taken off them.

    ``counts`` has one row per (column, key). The window that ranks has the rows of a column
    together, so the cut needs no further shuffle.
    """
    lead = top_keys(counts, check_cap(cap) + 1)
    beyond = F.max(F.when(F.col("rank") > cap, F.col("n"))).over(Window.partitionBy("column"))
    return lead.withColumn("cut", F.coalesce(beyond, F.lit(0)).cast("bigint"))


def held(lead: DataFrame) -> DataFrame:
    """(column, key, n): the counters that stay, each with the cut taken off."""
    return lead.where(F.col("n") > F.col("cut")).select(
        "column", "key", (F.col("n") - F.col("cut")).alias("n")
    )


def cuts(lead: DataFrame) -> DataFrame:
    """(column, cut): one row per column that has keys."""
    return lead.groupBy("column").agg(F.max("cut").alias("cut"))


def _listed(lead: DataFrame) -> DataFrame:
    """(column, cut, keys): counters as one array, of at most cap entries."""
    left = F.col("n") - F.col("cut")
    stays = F.when(left > 0, F.struct((-left).alias("o"), F.col("key").alias("key"), left.alias("n")))
    sorted_ = F.array_sort(F.collect_list(stays))
    pairs = F.transform(sorted_, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n")))
    return lead.groupBy("column").agg(F.max("cut").alias("cut"), pairs.alias("keys"))


_NO_KEYS = "array<struct<key:string,n:bigint>>"


def _summary(totals: DataFrame, lead: DataFrame) -> DataFrame:
    """One row per column of ``totals`` (column, rows, error); both sides have one per column."""
    return totals.join(_listed(lead), "column", "left").select(
        "column",
        "rows",
        (F.col("error") + F.coalesce("cut", F.lit(0))).alias("error"),
        F.coalesce("keys", F.array().cast(_NO_KEYS)).alias("keys"),
    )


def summarize(df: DataFrame, columns: str | Iterable[Candidate], cap: int = CAP) -> DataFrame:
    """(column, rows, error, keys): a summary per column; a true count is from n to n + error.

    ``rows`` counts the rows with a key. Null keys are not held.
    """
    freq = key_frequency(df, parse_candidates(columns, df.columns))
    present = F.sum(F.when(F.col("key").isNotNull(), F.col("n")).otherwise(0))
    totals = freq.groupBy("column").agg(present.alias("rows"), F.lit(0).cast("bigint").alias("error"))
    return _summary(totals, leading(freq, cap))


def merge(summaries: DataFrame, cap: int = CAP) -> DataFrame:
    """One summary per column from any number of them; errors add up, and the new cut to them."""
    totals = summaries.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("error").alias("error"))
    counts = (
        summaries.select("column", F.inline("keys"))
        .groupBy("column", "key")
        .agg(F.sum("n").alias("n"))
    )
    return _summary(totals, leading(counts, cap))


def guaranteed(n: Column, error: Column, rows: Column, share: float) -> Column:
    """What is known of a held key: 'heavy', 'light' or 'open' against a share of the rows."""
    return (
        F.when(n >= rows * share, F.lit("heavy"))
        .when(n + error < rows * share, F.lit("light"))
        .otherwise(F.lit("open"))
    )
