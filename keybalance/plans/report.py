"""The whole analysis of a table as one nested record."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from keybalance.functions.keys import Candidate, parse_candidates
from keybalance.operators import advisor, load
from keybalance.operators.frequency import TOP_K
from keybalance.operators.profile import BATCH_ROWS, profile, profile_bounded
from keybalance.sources.tables import schema_info

STATS_COLUMNS = [
    "column",
    "total_rows",
    "cardinality_estimate",
    "null_count",
    "null_fraction",
    "skew_ratio",
    "top_keys",
    "batch_count",
    "hll_error",
]


def column_report(profiles: DataFrame, workers: int, loads: DataFrame) -> DataFrame:
    """One row per column: profile, score, rank, advice sentence and load of the workers.

    ``loads`` has (column, loads): rows per worker, measured over all rows.
    """
    rows = advisor.rank(advisor.scored(profiles)).withColumn("explanation", advisor.explanation())
    rows = rows.join(F.broadcast(loads), "column", "left")  # one row per column
    return rows.withColumn("load", load.summary_of(F.col("loads"), workers)).withColumn(
        "workers", F.when(F.col("load").isNotNull(), load.workers_of(F.col("loads")))
    )


def _listed(order: str, fields: list[str]) -> Column:
    """The rows as an array of structs, sorted by the ``order`` column."""
    record = F.struct(*fields)
    pairs = F.collect_list(F.struct(F.col(order).alias("o"), record.alias("v")))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def nested_report(columns: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """One row: column_stats, scores (best first), loads, hints and schema_info."""
    types = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in schema.items()]
    )
    return columns.agg(
        _listed("position", STATS_COLUMNS).alias("column_stats"),
        _listed("rank", advisor.SCORE_COLUMNS).alias("scores"),
        _listed("position", ["column", "load", "workers"]).alias("loads"),
        _listed("position", ["column", "explanation"]).alias("hints"),
    ).withColumn("schema_info", types)


def report(
    df: DataFrame,
    columns: str | Iterable[Candidate],
    workers: int = 8,
    k: int = TOP_K,
    batch_rows: int = BATCH_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """The nested report of a table's candidate columns.

    The load is measured: all rows, nulls included, as ``repartition`` would spread
    them. ``bounded`` profiles without a shuffle of all keys.
    """
    load.check_slots(workers)
    candidates = parse_candidates(columns, df.columns)
    profiler = profile_bounded if bounded else profile
    rows = profiler(df, candidates, k=k, batch_rows=batch_rows)
    loads = load.load_arrays(load.hash_bucket_load(df, candidates, workers), workers)
    return nested_report(column_report(rows, workers, loads), schema_info(df))


def to_json(reports: DataFrame) -> DataFrame:
    """The report rows as JSON text, in the column ``report``."""
    return reports.select(F.to_json(F.struct(*reports.columns)).alias("report"))
