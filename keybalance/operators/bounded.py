"""Profiles without a shuffle of all keys: sketches, and exact top keys through hash buckets."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from keybalance.functions.keys import (
    Candidate,
    candidate_name,
    key_text,
    parse_candidates,
    resolve_key,
)
from keybalance.operators.frequency import TOP_K, key_frequency, top_keys
from keybalance.sources.tables import input_bytes
from keybalance.workdir import written

#: Registers of the built-in distinct sketch, as a power of two.
SKETCH_BITS = 14
#: Bits of the key's hash that tell buckets apart, level by level.
LEVELS = (18, 40, 64)
#: Open buckets that the next level is limited to; with more of them it counts all rows.
OPEN_BUCKETS = 1 << 17
#: Keys of equal count that are looked at by text to bound the texts that can rank.
TIED_KEYS = 4096
#: Input up to this size is counted by key at once.
DIRECT_BYTES = 1 << 30

# Types that the built-in distinct sketch takes as they are.
_SKETCHABLE = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)
_SLICES = 256


def standard_error(b: int = SKETCH_BITS) -> float:
    """Relative standard error of a distinct sketch of 2^b registers, 4 to 21."""
    if not 4 <= b <= 21:
        raise ValueError(f"a sketch has 2^4 to 2^21 registers, not 2^{b}")
    return 1.04 / math.sqrt(1 << b)


def bounded_state(
    df: DataFrame, columns: str | Iterable[Candidate], b: int = SKETCH_BITS
) -> DataFrame:
    """(column, total_rows, null_count, distinct): row counts and a built-in distinct sketch.

    One scan, and no key is shuffled: a task sends its sketches, first to one of 256
    slices and then merged to one row, so that no task receives the sketches of all
    scan tasks.
    """
    standard_error(b)
    inputs = [
        (F.spark_partition_id() % _SLICES).cast("int").alias("__slice"),
        F.lit(1).cast("bigint").alias("__one"),
    ]
    first, then = [F.sum("__one").alias("__total")], [F.sum("__total").alias("__total")]
    rows = []
    for i, candidate in enumerate(parse_candidates(columns, df.columns)):
        key = resolve_key(df, candidate)
        value = key.value if isinstance(key.group_type, _SKETCHABLE) else key.text(key.value)
        inputs.append(value.alias(f"__v{i}"))
        first += [F.count(f"__v{i}").alias(f"__n{i}"), F.hll_sketch_agg(f"__v{i}", b).alias(f"__d{i}")]
        then += [F.sum(f"__n{i}").alias(f"__n{i}"), F.hll_union_agg(f"__d{i}").alias(f"__d{i}")]
        rows.append(
            F.struct(
                F.lit(key.name).alias("column"),
                F.col("__total").alias("total_rows"),
                (F.col("__total") - F.col(f"__n{i}")).alias("null_count"),
                F.col(f"__d{i}").alias("distinct"),
            )
        )
    wide = df.select(*inputs)
    # The sketches cannot be merged from no rows at all: one blank row, counted as zero.
    blank = df.sparkSession.range(1).select(
        F.lit(0).alias("__slice"),
        F.lit(0).cast("bigint").alias("__one"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in wide.schema.fields[2:]],
    )
    state = wide.unionByName(blank).groupBy("__slice").agg(*first).agg(*then)
    return state.select(F.inline(F.array(*rows)))


def sketch_estimate(sketch: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).cast("double")


def fast_distinct(
    df: DataFrame, columns: str | Iterable[Candidate], b: int = SKETCH_BITS
) -> DataFrame:
    """(column, cardinality_estimate) from the built-in sketches."""
    state = bounded_state(df, columns, b)
    return state.select("column", sketch_estimate("distinct").alias("cardinality_estimate"))


def merged_sketches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(column, distinct): the union of two tables of sketches."""
    both = left.select("column", "distinct").unionByName(right.select("column", "distinct"))
    return both.groupBy("column").agg(F.hll_union_agg("distinct").alias("distinct"))


def _level(rows: DataFrame, bits: int) -> DataFrame:
    """Rows per bucket of the first ``bits`` of the key's hash, with the smallest and largest hash in it."""
    counts = rows.groupBy("column", _bucket(bits).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("low"), F.max("h").alias("high")
    )
    return written(counts, f"buckets-{bits}")


def _bucket(bits: int) -> Column:
    return F.shiftrightunsigned("h", 64 - bits) if bits < 64 else F.col("h")


def _floors(known: DataFrame, k: int) -> DataFrame:
    """(column, floor): the k-th largest count per column; no row for a column with fewer."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "h")
    ranked = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.where(F.col("rank") == k).select("column", F.col("n").alias("floor"))


def key_hash_counts(rows: DataFrame, k: int, levels: tuple[int, ...]) -> DataFrame:
    """(column, h, n): rows per key hash, for all keys that can be among the first k."""
    known, within, bits_before = None, None, 0
    for bits in levels:
        asked = rows
        if within is not None:
            asked = rows.withColumn("bucket", _bucket(bits_before)).join(
                F.broadcast(within), ["column", "bucket"], "left_semi"
            )
        counts = _level(asked, bits)
        single = counts.where("low = high").select("column", F.col("low").alias("h"), "n")
        known = single if known is None or within is None else known.unionByName(single)
        # Two keys or more share the bucket's rows, so each has fewer than all of them.
        shared = counts.where("low <> high").join(F.broadcast(_floors(known, k)), "column", "left")
        open_ = written(
            shared.where(F.col("n") > F.coalesce("floor", F.lit(0))).select("column", "bucket"), "open"
        )
        number = open_.count()
        if number == 0:
            return known
        within, bits_before = (open_ if number <= OPEN_BUCKETS else None), bits
    raise ValueError(f"the last level must have 64 bits, got {levels}")


def bucketed_top_keys(
    df: DataFrame,
    columns: str | Iterable[Candidate],
    k: int = TOP_K,
    levels: tuple[int, ...] = LEVELS,
    direct_bytes: int = DIRECT_BYTES,
) -> DataFrame:
    """(column, rank, key, n): the exact top k keys; only keys that can rank are counted by text.

    Rows are counted per bucket of the key's hash, with the smallest and the largest hash in it. A
    bucket with one hash has one key, whose count is then known; the k-th of those is a floor. A bucket of
    several keys is split by further bits of the hash only if its rows, less one, still reach the
    floor. What tasks send at a level are numbers, as many as buckets have rows, no text.

    Keys above the floor are fewer than k. If a great many have just its count, the smallest
    texts rank: the k-th smallest of a fixed number of those keys bounds the texts that are counted.
    So neither many keys nor equal counts make the keys themselves move.

    Keys are told apart by 64 bits of hash until they are counted by text. Input of up to
    ``direct_bytes`` is counted by key at once.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    requested = parse_candidates(columns, df.columns)
    size = input_bytes(df)
    if size is not None and size <= direct_bytes:
        return top_keys(key_frequency(df, requested), k)
    named = [
        F.struct(F.lit(candidate_name(c)).alias("column"), key_text(df, c).alias("key"))
        for c in requested
    ]
    rows = (
        df.select(F.inline(F.array(*named)))
        .where(F.col("key").isNotNull())
        .withColumn("h", F.xxhash64("key"))
    )
    known = key_hash_counts(rows, k, levels)
    over = F.col("n") > F.coalesce("floor", F.lit(0))
    ranking = written(
        known.join(F.broadcast(_floors(known, k)), "column", "left")
        .where(F.col("n") >= F.coalesce("floor", F.lit(0)))
        .select("column", "h", (over & F.col("floor").isNotNull()).alias("sure"))
        .withColumn("place", F.row_number().over(Window.partitionBy("column", "sure").orderBy("h")))
        .where(F.col("sure") | (F.col("place") <= TIED_KEYS + 1)),
        "ranking",
    )
    # At most k + TIED_KEYS + 1 rows per column, as are the keys below.
    wanted = F.broadcast(ranking.select("column", "h", F.lit(True).alias("wanted")))
    crowded = ranking.where(F.col("place") > TIED_KEYS).select("column").distinct()
    tied = ranking.where(~F.col("sure")).join(F.broadcast(crowded), "column", "left_semi")
    texts = rows.join(F.broadcast(tied.select("column", "h")), ["column", "h"], "left_semi")
    by_text = Window.partitionBy("column").orderBy("key")
    last = (
        texts.select("column", "key")
        .distinct()
        .withColumn("place", F.row_number().over(by_text))
        .where(F.col("place") <= k)
        .groupBy("column")
        .agg(F.max("key").alias("last"))
    )
    counted = rows.join(wanted, ["column", "h"], "left")
    if not crowded.isEmpty():
        counted = counted.join(F.broadcast(last), "column", "left").where(
            F.col("wanted") | (F.col("key") <= F.col("last"))
        )
    else:
        counted = counted.where("wanted")
    return top_keys(counted.groupBy("column", "key").agg(F.count(F.lit(1)).alias("n")), k)
