"""Running profile after each batch, from a table that carries a batch id."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from keybalance.functions.keys import Candidate, parse_candidates
from keybalance.operators.distribution import ranked_keys, with_shape
from keybalance.operators.frequency import (
    TOP_K,
    key_frequency,
    null_fraction,
    present_keys,
    top_keys,
)
from keybalance.workdir import written


#: Batches of one block, which one task folds over.
BLOCK = 256


def batch_snapshots(
    df: DataFrame, columns: str | Iterable[Candidate], batch: str, k: int = TOP_K
) -> DataFrame:
    """Per column and batch: the cumulative profile up to and including that batch.

    Running counts only grow. So a key that is among the first k at some batch, and was last touched
    at batch s, is among the first k of the keys touched at s; and a key not touched since
    some batch ranks no better than it did then. The first k at a batch follow from the first k of the
    batch before and of the keys that it touched. Batches are folded like that in blocks: first
    over the ends of the blocks, which gives the state each block starts from, then within
    every block on its own. A task sees k keys per batch of its block, whatever the number of keys and
    of batches.

    The counts per batch are written once to the shared folder, so the input is
    scanned once.
    """
    candidates = parse_candidates(columns, df.columns)
    freq = key_frequency(df, candidates, by=batch).withColumnRenamed(batch, "batch")
    given = F.when(F.col("batch").isNull(), F.raise_error(F.lit("batch id is null")))
    freq = written(freq.withColumn("batch", given.otherwise(F.col("batch"))), "batch-counts")
    totals = written(_running_totals(freq), "batch-totals")
    places = totals.select("column", "batch", (F.col("batch_count") - 1).alias("place"))
    leaders = folded(running_counts(freq, places), places, k).join(places, ["column", "place"])
    ranked = ranked_keys(top_keys(leaders, k, ("column", "batch")), ("column", "batch"))
    return (
        with_shape(totals.join(ranked, ["column", "batch"], "left"))
        .withColumn("null_fraction", null_fraction())
        .select(
            "column",
            "batch",
            "batch_count",
            "total_rows",
            "null_count",
            "null_fraction",
            "skew_ratio",
            "max_count",
            "top_rows",
            "top_keys",
            "partition_counts",
        )
    )


def _running_totals(freq: DataFrame) -> DataFrame:
    """Row and null counts up to each batch, and the batch's ordinal as batch_count.

    The windows hold one row per batch of a column.
    """
    nulls = F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0))
    per_batch = freq.groupBy("column", "batch").agg(F.sum("n").alias("rows"), nulls.alias("nulls"))
    running = Window.partitionBy("column").orderBy("batch")
    return per_batch.select(
        "column",
        "batch",
        F.row_number().over(running).alias("batch_count"),
        F.sum("rows").over(running).alias("total_rows"),
        F.sum("nulls").over(running).alias("null_count"),
    )


def running_counts(freq: DataFrame, places: DataFrame) -> DataFrame:
    """(column, key, place, n, until): a key's rows up to each of its batches, and the next of them.

    ``place`` is the batch's number in order; ``until`` is null at a key's last batch.
    """
    per_key = Window.partitionBy("column", "key").orderBy("place")
    return present_keys(freq).join(places, ["column", "batch"]).select(
        "column",
        "key",
        "place",
        F.sum("n").over(per_key).alias("n"),
        F.lead("place").over(per_key).alias("until"),
    )


def block_of(place: str) -> Column:
    return F.floor(F.col(place) / BLOCK).cast("int")


def leading_counts(running: DataFrame, k: int) -> DataFrame:
    """The running counts that can rank: at most k keys per column and batch."""
    return top_keys(running, k, ("column", "place")).select("column", "place", "key", "n")


def block_ends(running: DataFrame, k: int) -> DataFrame:
    """(column, block, key, n): counts at the end of a block of the keys it touched, k at most."""
    at_end = F.col("until").isNull() | (block_of("until") > block_of("place"))
    ends = running.where(at_end).withColumn("block", block_of("place"))
    return top_keys(ends, k, ("column", "block")).select("column", "block", "key", "n")


def _states(rows: pd.DataFrame, k: int, before: bool) -> Iterator[tuple[int, dict[str, int]]]:
    """The first k keys at each place in order: before its rows or, by default, with them."""
    state: dict[str, int] = {}
    for place, some in rows.sort_values("place").groupby("place", sort=True):
        if before:
            yield place, state
        new = {key: n for key, n in zip(some["key"], some["n"]) if key is not None}
        state = state | new
        if len(state) > k:
            state = dict(heapq.nsmallest(k, state.items(), key=lambda kn: (-kn[1], kn[0])))
        if not before:
            yield place, state


def _fold(k: int, before: bool):
    """For ``applyInPandas``: rows of a column (and block) to the first k keys at each place."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        column = rows["column"].iloc[0]
        out = [
            (column, int(place), key, n)
            for place, state in _states(rows, k, before)
            for key, n in state.items()
            if place >= 0
        ]
        return pd.DataFrame(out, columns=["column", "place", "key", "n"])

    return fold


_STATE = "column string, place int, key string, n bigint"


def folded(running: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(column, place, key, n): the first k keys at every batch."""
    # A row without a key for each place, so that a batch that touched no key has its state too.
    no_key = [F.lit(None).cast("string").alias("key"), F.lit(0).cast("bigint").alias("n")]
    blocks = places.select("column", block_of("place").alias("place")).distinct().select("*", *no_key)
    ends = block_ends(running, k).withColumnRenamed("block", "place")
    carried = ends.unionByName(blocks).groupBy("column").applyInPandas(_fold(k, before=True), _STATE)
    # What a block starts from stands at a place before all of its own.
    starts = carried.select("column", F.col("place").alias("block"), F.lit(-1).alias("place"), "key", "n")
    inside = leading_counts(running, k).unionByName(places.select("column", "place", *no_key))
    rows = inside.withColumn("block", block_of("place")).unionByName(starts)
    return rows.groupBy("column", "block").applyInPandas(_fold(k, before=False), _STATE)
