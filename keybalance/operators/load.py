"""How keys load n slots: measured, packed, and laid out."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from keybalance.functions.hashing import row_identity
from keybalance.functions.keys import Candidate, candidate_name, column_ref, parse_candidates
from keybalance.operators.heavy import bucket_counts, bucket_number, hash_bucket, heavy_keys


def check_slots(n: int) -> int:
    if n < 1:
        raise ValueError(f"rows need at least one slot, got {n}")
    return n


def _heavy_parts(n: int) -> int:
    """A key is packed on its own if it holds more than one of this many parts: a tenth of
    a slot's fair share, for any n."""
    return 10 * n


def hash_bucket_load(df: DataFrame, columns: str | Iterable[Candidate], n: int) -> DataFrame:
    """(column, slot, rows) as ``repartition(n, column)`` would spread the rows.

    Counts every row, nulls included, straight from the scan: the shuffle carries
    n small rows per column and task, not the keys.
    """
    check_slots(n)
    spread = [
        F.struct(
            F.lit(candidate_name(c)).alias("column"),
            hash_bucket((c,) if isinstance(c, str) else c, n).alias("slot"),
        )
        for c in parse_candidates(columns, df.columns)
    ]
    return (
        df.select(F.inline(F.array(*spread)))
        .groupBy("column", "slot")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _pack(items: pd.Series, loads: pd.Series) -> pd.Series:
    """Per row: the slot of each item in its order, each to the least loaded slot so far.

    Ties go to the lowest slot. A heap makes a step cost log n, which matters for
    thousands of items on thousands of slots.
    """

    def taken(rows, start):
        heap = [(int(load), slot) for slot, load in enumerate(start)]
        heapq.heapify(heap)
        slots = []
        for count in rows:
            load, slot = heap[0]
            slots.append(slot)
            heapq.heapreplace(heap, (load + int(count), slot))
        return slots

    return pd.Series([taken(rows, start) for rows, start in zip(items, loads)])


def load_arrays(loads: DataFrame, n: int) -> DataFrame:
    """(column, loads): rows of slots 0..n-1 in one array, zero for slots that got none.

    The slots that got rows are sorted, and the gaps between them filled: linear in n.
    """
    zero = F.lit(0).cast("bigint")
    sorted_ = F.array_sort(F.collect_list(F.struct("slot", F.col("rows").cast("bigint").alias("rows"))))
    by_column = loads.groupBy("column").agg(sorted_.alias("found"))
    found = F.col("found")

    def with_gap(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(found, i - 1)["slot"])
        return F.concat(F.array_repeat(zero, x["slot"] - before - 1), F.array(x["rows"]))

    rest = F.array_repeat(zero, F.lit(check_slots(n) - 1) - F.element_at(found, -1)["slot"])
    return by_column.select("column", F.concat(F.flatten(F.transform(found, with_gap)), rest).alias("loads"))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a + x)


def workers_of(loads: Column) -> Column:
    """Rows per slot and how many it lacks to the fullest; the lowest of the fullest straggles."""
    most = F.array_max(loads)
    straggler = F.array_position(loads, most) - 1
    return F.transform(
        loads,
        lambda rows, i: F.struct(
            i.alias("worker_id"),
            rows.alias("assigned_rows"),
            (i == straggler).alias("is_straggler"),
            (most - rows).alias("idle_rows"),
        ),
    )


def summary_of(loads: Column, n: int) -> Column:
    """Rows in all, on the fullest slot and on average; slowdown and idle share. Null without rows."""
    total, most = _sum(loads), F.array_max(loads)
    mean = total / F.lit(check_slots(n))
    return F.when(
        total > 0,
        F.struct(
            F.lit(n).alias("num_workers"),
            total.alias("total_rows"),
            most.alias("max_rows"),
            mean.alias("mean_rows"),
            (most / mean).alias("slowdown_factor"),
            (F.array_position(loads, most) - 1).cast("int").alias("straggler_worker_id"),
            (1 - mean / most).alias("idle_fraction"),
        ),
    )


def worker_load(loads: DataFrame, n: int) -> DataFrame:
    """One row per (column, slot); columns without rows give none."""
    return (
        load_arrays(loads, n)
        .where(F.array_max("loads") > 0)
        .select("column", F.inline(workers_of(F.col("loads"))))
    )


def load_report(loads: DataFrame, n: int) -> DataFrame:
    """One row per column: the fullest slot against the mean, and the idle share."""
    return (
        load_arrays(loads, n)
        .select("column", summary_of(F.col("loads"), n).alias("s"))
        .where(F.col("s").isNotNull())
        .select("column", "s.*")
    )


def slot_map(
    df: DataFrame, columns: Sequence[str], n: int, split_oversized: bool = True
) -> DataFrame:
    """(*columns, slots): where the heavy keys go; all other keys stay hashed.

    Heavy keys (see ``_heavy_parts``, fewer than that many) are packed longest first
    on top of the load that the hashed light keys already put on each slot. If
    ``split_oversized``, a key beyond a whole share is cut into pieces of one part;
    ``slots`` then has one entry per piece. What is packed depends on n, not on the
    size of the data.
    """
    check_slots(n)
    parts = _heavy_parts(n)
    # A multiple of n: bucket modulo n is then the hash partition.
    buckets = bucket_number(parts, n)
    heavy = heavy_keys(df, columns, parts, buckets)
    refs = [column_ref(c) for c in columns]
    rows = F.col("rows").cast("bigint")
    light = reduce(
        DataFrame.unionByName,
        [
            bucket_counts(df, columns, buckets).select(
                (F.col("bucket") % n).alias("slot"), F.col("n").alias("rows")
            ),
            heavy.select(hash_bucket(columns, n).alias("slot"), (-F.col("n")).alias("rows")),
            df.sparkSession.range(n).select(
                F.col("id").cast("int").alias("slot"), F.lit(0).cast("bigint").alias("rows")
            ),
        ],
    ).groupBy("slot").agg(F.sum("rows").alias("rows"))
    shares = F.lit(1)
    if split_oversized:
        cut = F.ceil(F.col("n") * parts / F.col("total")).cast("int")
        shares = F.when(F.col("n") * n > F.col("total"), cut).otherwise(shares)
    pieces = (
        heavy.select(F.struct(*refs).alias("key"), "n", shares.alias("shares"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .withColumn(
            "rows",
            F.expr("n div shares + if(piece < n % shares, 1, 0)"),
        )
    )
    # Sorted by rows descending, then key, so that the packing is repeatable.
    item = F.struct((-rows).alias("order"), F.to_json("key").alias("text"), "piece", "key", "rows")
    blank_item = pieces.select(F.lit(None).cast("int").alias("slot"), "rows", item.alias("item"))
    everything = light.select(
        "slot", "rows", F.lit(None).cast(blank_item.schema["item"].dataType).alias("item")
    ).unionByName(blank_item)
    bounded = everything.agg(
        F.array_sort(
            F.collect_list(F.when(F.col("item").isNull(), F.struct("slot", "rows")))
        ).alias("loads"),
        F.sort_array(F.collect_list("item")).alias("items"),
    )
    sizes = bounded.select(
        "items",
        F.transform("items", lambda x: x["rows"]).alias("sizes"),
        F.transform("loads", lambda x: x["rows"]).alias("loads"),
    )
    return (
        sizes.select("items", _pack("sizes", "loads").alias("taken"))
        .select(F.inline(F.arrays_zip("items", "taken")).alias("item", "slot"))
        .select("item.key.*", F.struct("item.piece", "slot").alias("__piece"))
        .groupBy(*refs)
        .agg(F.array_sort(F.collect_list("__piece")).alias("slots"))
        .withColumn("slots", F.transform("slots", lambda x: x["slot"]))
    )


def assign_slots(
    df: DataFrame,
    columns: Sequence[str],
    n: int,
    split_oversized: bool = True,
    identity: list[str] | None = None,
    slot: str = "slot",
) -> DataFrame:
    """``df`` with the slot of every row under the balanced layout."""
    mapped = slot_map(df, columns, n, split_oversized)
    names = [f"__m{i}" for i in range(len(columns))]
    mapped = mapped.select(
        *[column_ref(c).alias(m) for c, m in zip(columns, names)],
        F.col("slots").alias("__slots"),
    )
    tagged = df.withColumn(
        "__row", F.xxhash64(*row_identity(df, identity)) if split_oversized else F.lit(0)
    )
    same = reduce(
        lambda a, b: a & b, [column_ref(c).eqNullSafe(F.col(m)) for c, m in zip(columns, names)]
    )
    piece = F.pmod(F.col("__row"), F.size("__slots")).cast("int")
    return (
        tagged.join(F.broadcast(mapped), same, "left")
        .withColumn(
            slot,
            F.when(F.col("__slots").isNull(), hash_bucket(columns, n)).otherwise(
                F.get("__slots", piece)
            ),
        )
        .drop("__row", "__slots", *names)
    )


def balanced_repartition(
    df: DataFrame,
    columns: Sequence[str],
    n: int,
    split_oversized: bool = True,
    identity: list[str] | None = None,
) -> DataFrame:
    """``df`` laid out in n partitions of near-equal size, keyed by ``columns``.

    Without ``split_oversized`` every key stays whole, and a key above total / n
    rows makes its partition that large.
    """
    placed = assign_slots(df, columns, n, split_oversized, identity, slot="__slot")
    return placed.repartitionById(n, F.col("__slot")).drop("__slot")
