"""Skew ratio and entropy of a column, over all its keys or its top keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TOP_KEYS_TYPE = "array<struct<key:string,count:bigint>>"


def ranked_keys(top: DataFrame, within: tuple[str, ...] = ("column",)) -> DataFrame:
    """(*within, top_keys): the rows of ``top`` as one array per group, by rank.

    ``top`` is already partitioned by its group, so this adds no shuffle; the arrays
    hold at most k items.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "key", "n")))
    return top.groupBy(*within).agg(ranked.alias("ranked")).select(
        *within,
        F.transform("ranked", lambda x: F.struct(x["key"].alias("key"), x["n"].alias("count"))).alias(
            "top_keys"
        ),
    )


def _fold(array: Column, zero: Column, term) -> Column:
    return F.aggregate(array, zero, lambda total, x: total + term(x))


def with_shape(df: DataFrame) -> DataFrame:
    """``df`` with what follows from its ``top_keys``: counts, mean, skew and entropy."""
    top = F.coalesce("top_keys", F.array().cast(TOP_KEYS_TYPE))
    counts, size = F.col("partition_counts"), F.size("partition_counts")
    total = F.col("top_rows").cast("double")
    n_log_n = _fold(counts, F.lit(0.0), lambda n: n.cast("double") * F.ln(n.cast("double")))
    # Rounding can leave a few ulps below zero.
    nats = F.greatest(F.ln(total) - n_log_n / total, F.lit(0.0))
    mean = F.when(size > 0, total / size)
    return (
        df.withColumns({"top_keys": top, "partition_counts": F.transform(top, lambda x: x["count"])})
        .withColumns(
            {
                "top_key_count": size,
                "top_rows": _fold(counts, F.lit(0).cast("bigint"), lambda n: n),
                "max_count": F.array_max("partition_counts"),
            }
        )
        .withColumns(
            {
                "mean_count": mean,
                "skew_ratio": F.coalesce(F.col("max_count") / mean, F.lit(1.0)),
                "entropy": F.when(size > 1, nats).otherwise(F.lit(0.0)),
            }
        )
    )


def distribution(top: DataFrame, within: tuple[str, ...] = ("column",)) -> DataFrame:
    """One row per group of ranked top keys: arrays, mean, skew ratio and entropy."""
    return with_shape(ranked_keys(top, within))


def normalized_entropy(entropy: Column, key_count: Column) -> Column:
    """Entropy as a percentage of the largest possible one; 0 for 0 or 1 keys."""
    return F.when(key_count > 1, F.lit(100.0) * entropy / F.ln(key_count)).otherwise(F.lit(0.0))


def whole_shape_columns() -> dict[str, Column]:
    """Aggregates of (key, n) rows over all keys: key_count, key_rows, max_key, and skew and entropy parts."""
    n = F.when(F.col("key").isNotNull() & (F.col("n") > 0), F.col("n"))
    return {
        "key_count": F.count(n),
        "key_rows": F.coalesce(F.sum(n), F.lit(0)).cast("bigint"),
        "max_key": F.max(n),
        "n_log_n": F.sum(n.cast("double") * F.ln(n.cast("double"))),
    }


def with_whole_shape(df: DataFrame) -> DataFrame:
    """``df`` with key_skew_ratio and key_entropy from the aggregates above."""
    rows = F.col("key_rows").cast("double")
    nats = F.greatest(F.ln(rows) - F.col("n_log_n") / rows, F.lit(0.0))
    return df.withColumns(
        {
            "key_skew_ratio": F.coalesce(
                F.col("max_key") * F.col("key_count") / F.when(rows > 0, rows), F.lit(1.0)
            ),
            "key_entropy": F.when(F.col("key_count") > 1, nats).otherwise(F.lit(0.0)),
        }
    )


def whole_distribution(freq: DataFrame) -> DataFrame:
    """One row per column over all its keys: one partial aggregate of the frequency table.

    column, key_count, key_rows, max_key, key_skew_ratio, key_entropy.
    """
    shaped = freq.groupBy("column").agg(*[c.alias(a) for a, c in whole_shape_columns().items()])
    return with_whole_shape(shaped).drop("n_log_n")
