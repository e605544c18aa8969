"""Scores, ranking and bands of profiled columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keybalance.operators.profile import with_normalized_entropy

# The skew ratio at which the penalty is full, and the advice sentences.
MAX_SKEW_RATIO = 50.0
GOOD = "Good partition key candidate"
MODERATE_SKEW = "Moderate skew — consider salting or composite key"
HIGH_NULLS = "High null rate — add NOT NULL filter or composite key"
ACCEPTABLE = "Acceptable partition key"
HIGH_SKEW = "High skew — salting recommended before production use"
SEVERE = "Severely skewed or sparse — repartition required"
EXPLANATION = (
    "Column '%s' has a skew ratio of %.1fx (top partition is %.1fx the mean). "
    "Estimated cardinality: %s. %s"
)
SALTING = "Salting with 8 buckets should reduce hot-key concentration by ~8x."
STANDARD = "Standard repartition should suffice."


def _advice(composite: Column) -> Column:
    skew, nulls = F.col("skew_ratio"), F.col("null_fraction")

    def verdict(severity: str, sentence: str) -> Column:
        return F.struct(F.lit(sentence).alias("recommendation"), F.lit(severity).alias("severity"))

    return (
        F.when(composite >= 75, verdict("good", GOOD))
        .when((composite >= 50) & (skew > 10), verdict("warning", MODERATE_SKEW))
        .when((composite >= 50) & (nulls > 0.1), verdict("warning", HIGH_NULLS))
        .when(composite >= 50, verdict("info", ACCEPTABLE))
        .when(composite >= 25, verdict("danger", HIGH_SKEW))
        .otherwise(verdict("critical", SEVERE))
    )


def _penalized(profiles: DataFrame) -> DataFrame:
    clamped = F.least("skew_ratio", F.lit(MAX_SKEW_RATIO))
    return profiles.withColumns(
        {
            "null_penalty": F.lit(100.0) * F.col("null_fraction"),
            "skew_penalty": F.lit(100.0) * clamped / F.lit(MAX_SKEW_RATIO),
        }
    )


SCORE_COLUMNS = [
    "column",
    "composite_score",
    "entropy_score",
    "null_penalty",
    "skew_penalty",
    "recommendation",
    "severity",
]


def scored(profiles: DataFrame) -> DataFrame:
    """Profile rows with their score; the advice uses the unrounded composite."""
    composite = (
        F.lit(0.4) * F.col("entropy_score")
        + F.lit(0.3) * (F.lit(100.0) - F.col("null_penalty"))
        + F.lit(0.3) * (F.lit(100.0) - F.col("skew_penalty"))
    )
    full = _penalized(with_normalized_entropy(profiles)).withColumn("composite", composite)
    advised = full.withColumn("advice", _advice(F.col("composite")))
    return advised.select(
        *profiles.columns,
        F.round("composite", 1).alias("composite_score"),
        *[F.round(c, 1).alias(c) for c in ("entropy_score", "null_penalty", "skew_penalty")],
        "advice.recommendation",
        "advice.severity",
    )


def score(profiles: DataFrame) -> DataFrame:
    """One score row per profile row."""
    return scored(profiles).select(*SCORE_COLUMNS, "position")


def rank(scores: DataFrame) -> DataFrame:
    """Best column first; equal rounded scores keep request order. One row per column."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("composite_score"), F.asc("position"))
    return scores.withColumn("rank", F.row_number().over(order))


def skew_band(ratio: Column) -> Column:
    # The limits of the bands and their names.
    return (
        F.when(ratio <= 1.5, "Healthy")
        .when(ratio <= 3, "Mild Skew")
        .when(ratio <= 8, "Moderate Skew")
        .when(ratio <= 20, "High Skew")
        .otherwise("Severe Skew")
    )


def flags(profiles: DataFrame) -> DataFrame:
    """Skew band, and the marks for a high null rate or penalty."""
    return _penalized(profiles).select(
        "column",
        "skew_ratio",
        skew_band(F.col("skew_ratio")).alias("skew_band"),
        (F.col("null_fraction") > 0.1).alias("high_null_rate"),
        (F.round("null_penalty", 1) > 30).alias("high_null_penalty"),
        (F.round("skew_penalty", 1) > 30).alias("high_skew_penalty"),
    )


def explanation() -> Column:
    """The advice sentence of a profile row."""
    return F.format_string(
        EXPLANATION,
        F.col("column"),
        F.col("skew_ratio"),
        F.col("skew_ratio"),
        F.format_number(F.floor("cardinality_estimate").cast("bigint"), 0),
        F.when(F.col("skew_ratio") > 5, SALTING).otherwise(STANDARD),
    )
