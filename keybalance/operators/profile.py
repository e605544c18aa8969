"""Column profile: one row per requested column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from keybalance.functions.keys import Candidate, candidate_name, parse_candidates
from keybalance.operators.bounded import (
    SKETCH_BITS,
    bounded_state,
    bucketed_top_keys,
    sketch_estimate,
    standard_error,
)
from keybalance.operators.distribution import (
    normalized_entropy,
    ranked_keys,
    whole_shape_columns,
    with_shape,
    with_whole_shape,
)
from keybalance.operators.frequency import (
    TOP_K,
    key_frequency,
    null_fraction,
    request_order,
    top_keys,
)

BATCH_ROWS = 50_000

PROFILE_COLUMNS = [
    "column",
    "total_rows",
    "cardinality_estimate",
    "null_count",
    "null_fraction",
    "skew_ratio",
    "top_keys",
    "partition_counts",
    "batch_count",
    "hll_error",
    "entropy",
    "mean_count",
    "key_skew_ratio",
    "key_entropy",
    "position",
]


def requested_columns(like: DataFrame, names: list[str]) -> DataFrame:
    """One row per requested column, without reading any table."""
    return like.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("column")
    )


def _totals(freq: DataFrame, names: list[str]) -> DataFrame:
    """Row and distinct counts, skew and entropy over all keys, per column.

    One partial aggregate of the frequency table, which has a row per distinct key. A
    zero row per requested column keeps empty columns.
    """
    blank = requested_columns(freq, names).select(
        "column", F.lit(None).cast("string").alias("key"), F.lit(0).cast("bigint").alias("n")
    )
    nulls = F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0))
    whole = whole_shape_columns()
    counted = (
        freq.select("column", "key", "n")
        .unionByName(blank)
        .groupBy("column")
        .agg(
            F.sum("n").alias("total_rows"),
            nulls.alias("null_count"),
            *[c.alias(a) for a, c in whole.items()],
        )
    )
    return with_whole_shape(counted).withColumn(
        "cardinality_estimate", F.col("key_count").cast("double")
    )


def assemble(
    counted: DataFrame,
    candidates: list[Candidate],
    error: float = 0.0,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Profile rows from one row per column of totals, distinct count and top keys.

    ``error`` is the relative standard error of the distinct count, 0 where it is exact.
    Skew and entropy over all keys are null where only the top keys were counted.
    """
    derived = {
        "null_fraction": null_fraction(),
        "hll_error": F.lit(error),
        "position": request_order(candidates),
    }
    if "batch_count" not in counted.columns:
        derived["batch_count"] = F.ceil(F.col("total_rows") / F.lit(batch_rows)).cast("bigint")
    for name in ("key_skew_ratio", "key_entropy"):
        if name not in counted.columns:
            derived[name] = F.lit(None).cast("double")
    return with_shape(counted.withColumns(derived)).select(*PROFILE_COLUMNS)


def with_top_keys(totals: DataFrame, top: DataFrame) -> DataFrame:
    """Totals with the ranked top keys; both sides have one row per column."""
    return totals.join(F.broadcast(ranked_keys(top)), "column", "left")


def profile_frequency(
    freq: DataFrame,
    candidates: list[Candidate],
    k: int = TOP_K,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Profile from a frequency table. Both branches read its one shuffle."""
    names = [candidate_name(c) for c in candidates]
    counted = with_top_keys(_totals(freq, names), top_keys(freq, k))
    return assemble(counted, candidates, batch_rows=batch_rows)


def profile(
    df: DataFrame,
    columns: str | Iterable[Candidate],
    k: int = TOP_K,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """Exact profile: rows, nulls, distinct keys, top keys, skew, entropy."""
    candidates = parse_candidates(columns, df.columns)
    return profile_frequency(key_frequency(df, candidates), candidates, k, batch_rows)


def profile_bounded(
    df: DataFrame,
    columns: str | Iterable[Candidate],
    k: int = TOP_K,
    b: int = SKETCH_BITS,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """The same profile for key sets that are costly to shuffle.

    Row and null counts and the top keys are exact (see ``bucketed_top_keys``); the
    distinct count comes from the built-in sketch, and skew and entropy are those of
    the top keys only.
    """
    requested = parse_candidates(columns, df.columns)
    totals = bounded_state(df, requested, b).select(
        "column",
        "total_rows",
        "null_count",
        sketch_estimate("distinct").alias("cardinality_estimate"),
    )
    top = bucketed_top_keys(df, requested, k)
    return assemble(with_top_keys(totals, top), requested, standard_error(b), batch_rows)


def column_profile(profiles: DataFrame, candidates: list[Candidate], column: str) -> DataFrame:
    """The profile of one column; asking for one that is not profiled is an error."""
    if column not in [candidate_name(c) for c in candidates]:
        raise KeyError(f"no profile of {column!r} was asked for")
    return profiles.where(F.col("column") == column)


def with_normalized_entropy(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn(
        "entropy_score", normalized_entropy(F.col("entropy"), F.size("partition_counts"))
    )
