"""

Every query reads the given tables whole. ``HOT`` is the events table with a key
made skewed and partly null, as the tables themselves are near-uniform.
"""

from __future__ import annotations

import importlib
import sys
import warnings
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F  # noqa: E402

from keybalance.functions.keys import parse_candidates  # noqa: E402
from keybalance.operators import (  # noqa: E402
    advisor,
    bounded,
    cms,
    composite,
    frequency,
    heavy,
    load,
    profile as profiles,
    remedy,
    summary,
)
from keybalance.operators.distribution import (  # noqa: E402
    distribution,
    normalized_entropy as entropy_share,
    whole_distribution,
)
from keybalance.plans import report as reports  # noqa: E402
from keybalance.sources import sinks, staging, tables, zipf  # noqa: E402
from keybalance.sources.arrow_ipc import read_arrow_ipc  # noqa: E402
from keybalance.streaming import profile_stream as streams, snapshots  # noqa: E402
from keybalance.streaming.versions import Versions  # noqa: E402
from keybalance.workdir import fresh_dir  # noqa: E402

HOT_COLUMNS = ["hot_key", "event_type"]
WORKERS = 8


# ---------------------------------------------------------------- inputs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.load_table(spark, f"{sf_dir}/{name}.parquet")


def _hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ``hot_key``: a twentieth null, two fifths of the rest one value."""
    key = (
        F.when(F.col("event_id") % 20 == 0, None)
        .when(F.col("event_id") % 5 < 2, F.lit(0))
        .otherwise(F.col("user_id"))
    )
    return _table(spark, sf_dir, "events").withColumn("hot_key", key)


def _hot_prop() -> Column:
    """A skewed, partly null key of few values."""
    return (
        F.when(F.col("event_id") % 20 == 0, None)
        .when(F.col("event_id") % 5 < 2, F.lit("none"))
        .otherwise(F.col("props"))
    )


def _joined(array: str):
    return F.array_join(F.col(array).cast("array<string>"), ",")


def _flat_profile(rows: DataFrame) -> DataFrame:
    """A profile with its arrays as text, for comparison by value."""
    return rows.select(
        "column",
        "total_rows",
        F.round("cardinality_estimate", 6).alias("cardinality_estimate"),
        "null_count",
        F.round("null_fraction", 6).alias("null_fraction"),
        F.round("skew_ratio", 6).alias("skew_ratio"),
        F.array_join(F.transform("top_keys", lambda x: x["key"]), ",").alias("top_keys"),
        _joined("partition_counts").alias("partition_counts"),
        "batch_count",
        F.round("hll_error", 6).alias("hll_error"),
    )


# ---------------------------------------------------------------- sources


def parquet_scan(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem")


def schema_info(spark, sf_dir):
    columns = tables.schema_info(_table(spark, sf_dir, "lineitem"))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in columns.items()]
    return _table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.inline(F.array(*rows))
    )


def csv_roundtrip(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    path = staging.stage_csv(orders, sep=";")
    return tables.read_csv(spark, path, schema=orders.schema, sep=";")


def arrow_roundtrip(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return read_arrow_ipc(spark, staging.stage_arrow_ipc(orders), orders.schema)


def zipf_table(spark, sf_dir):
    return zipf.skewed_table(_table(spark, sf_dir, "events"), ["event_id"])


def partitioned_write(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    path = fresh_dir(spark, "by-type")
    sinks.write_partitioned(events, ["event_type"], path)
    back = sinks.read_partitioned(spark, path, events.schema)
    return back.select("event_type", "event_id", "user_id", "value")


# ---------------------------------------------------------------- profile


def long_form(spark, sf_dir):
    return frequency.long_form(_hot(spark, sf_dir), HOT_COLUMNS)


def key_frequency(spark, sf_dir):
    return frequency.key_frequency(
        _table(spark, sf_dir, "lineitem"), "l_partkey, l_suppkey, l_returnflag, l_shipdate"
    )


def null_counts(spark, sf_dir):
    rows = frequency.null_counts(_hot(spark, sf_dir), HOT_COLUMNS)
    return rows.withColumn("null_fraction", F.round("null_fraction", 6))


def footer_counts(spark, sf_dir):
    """Row and null counts from footers, of a copy with null keys that Spark writes."""
    path = fresh_dir(spark, "hot")
    _hot(spark, sf_dir).write.parquet(path)
    rows = tables.footer_counts(spark, path, ["hot_key", "event_type", "ts"])
    return rows.withColumn("null_fraction", F.round("null_fraction", 6))


def top_k_keys(spark, sf_dir):
    freq = frequency.key_frequency(_table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])
    return frequency.top_keys(freq)


def approx_top_k(spark, sf_dir):
    """Exact top keys of columns with few and with many keys; small input is counted at once."""
    lineitem = _table(spark, sf_dir, "lineitem")
    return bounded.bucketed_top_keys(lineitem, ["l_partkey", "l_orderkey", "l_returnflag"])


def refined_top_k(spark, sf_dir):
    """The same through hash buckets level by level, also of a column in which all counts are equal."""
    lineitem = _table(spark, sf_dir, "lineitem").withColumn(
        "line", F.concat_ws("-", "l_orderkey", "l_linenumber")
    )
    return bounded.bucketed_top_keys(lineitem, ["l_partkey", "l_orderkey", "line"], direct_bytes=0)


def heavy_keys(spark, sf_dir):
    found = heavy.heavy_keys(_hot(spark, sf_dir), ["hot_key"], 25)
    return found.select(F.col("hot_key").cast("bigint").alias("hot_key"), "n", "total")


def _distribution(spark, sf_dir):
    freq = frequency.key_frequency(_hot(spark, sf_dir), HOT_COLUMNS)
    return distribution(frequency.top_keys(freq))


def _shapes(spark, sf_dir):
    """Over all keys, and over the top keys, of columns with many keys."""
    freq = frequency.key_frequency(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_shipdate"])
    top = distribution(frequency.top_keys(freq))
    # One row per column on both sides.
    return whole_distribution(freq).join(F.broadcast(top), "column")


def skew_ratio(spark, sf_dir):
    return _shapes(spark, sf_dir).select(
        "column",
        "max_count",
        "key_count",
        F.round("key_skew_ratio", 6).alias("skew_ratio"),
        F.round("mean_count", 6).alias("top_mean_count"),
        F.round("skew_ratio", 6).alias("top_skew_ratio"),
    )


def entropy(spark, sf_dir):
    return _shapes(spark, sf_dir).select(
        "column",
        F.round("key_entropy", 6).alias("entropy"),
        F.round("entropy", 6).alias("top_entropy"),
    )


def normalized_entropy(spark, sf_dir):
    rows = profiles.with_normalized_entropy(_shapes(spark, sf_dir))
    whole = entropy_share(F.col("key_entropy"), F.col("key_count"))
    return rows.select(
        "column",
        F.round(whole, 6).alias("entropy_score"),
        F.round("entropy_score", 6).alias("top_entropy_score"),
    )


def column_profile(spark, sf_dir):
    return _flat_profile(profiles.profile(_hot(spark, sf_dir), HOT_COLUMNS))


def one_column_profile(spark, sf_dir):
    hot = _hot(spark, sf_dir)
    candidates = parse_candidates(HOT_COLUMNS, hot.columns)
    rows = profiles.profile(hot, candidates)
    return _flat_profile(profiles.column_profile(rows, candidates, "hot_key"))


def bounded_profile(spark, sf_dir):
    """Exact but for the distinct count, which is compared with the exact one."""
    columns = ["l_partkey", "l_orderkey", "l_returnflag"]
    lineitem = _table(spark, sf_dir, "lineitem")
    rows = _flat_profile(profiles.profile_bounded(lineitem, columns))
    exact = whole_distribution(frequency.key_frequency(lineitem, columns))
    error = F.abs(F.col("cardinality_estimate") / F.col("key_count") - 1)
    # One row per column on both sides.
    return rows.join(F.broadcast(exact.select("column", "key_count")), "column").select(
        *[c for c in rows.columns if c not in ("cardinality_estimate", "hll_error")],
        (error <= 3 * bounded.standard_error()).alias("within_bound"),
    )


def composite_key_profile(spark, sf_dir):
    return _flat_profile(profiles.profile(_hot(spark, sf_dir), [("event_type", "hot_key")]))


def composite_key_search(spark, sf_dir):
    """The best of all sets of up to three columns for a thousand partitions."""
    columns = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]
    best = composite.best_composite(_table(spark, sf_dir, "lineitem"), columns, 1000)
    return best.select(
        F.array_join("columns", "|").alias("columns"), "hottest_rows", "total_rows", "fits"
    )


def not_null_profile(spark, sf_dir):
    kept = frequency.not_null(_hot(spark, sf_dir), "hot_key")
    return _flat_profile(profiles.profile(kept, ["hot_key"]))


# ---------------------------------------------------------------- sketches


def _custkeys(spark, sf_dir, table: str, column: str) -> DataFrame:
    keys = _table(spark, sf_dir, table).select(F.col(column).alias("custkey"))
    return frequency.key_frequency(keys, ["custkey"])


def _against_exact(freq: DataFrame, estimates: DataFrame, b: int = bounded.SKETCH_BITS) -> DataFrame:
    """Exact distinct counts, and whether the sketch is within three standard errors."""
    exact = whole_distribution(freq).select("column", F.col("key_count").alias("distinct_keys"))
    error = F.abs(F.col("cardinality_estimate") / F.col("distinct_keys") - 1)
    # One row per column on both sides.
    return exact.join(F.broadcast(estimates), "column").select(
        "column", "distinct_keys", (error <= 3 * bounded.standard_error(b)).alias("within_bound")
    )


def _estimated(sketches: DataFrame) -> DataFrame:
    return sketches.select("column", bounded.sketch_estimate("distinct").alias("cardinality_estimate"))


def hll_registers(spark, sf_dir):
    """Sketches of a column with nulls, with the row counts that go with them."""
    hot = _hot(spark, sf_dir)
    state = bounded.bounded_state(hot, HOT_COLUMNS)
    checked = _against_exact(frequency.key_frequency(hot, HOT_COLUMNS), _estimated(state))
    return checked.join(F.broadcast(state.select("column", "total_rows", "null_count")), "column")


def hll_estimate(spark, sf_dir):
    columns, lineitem = ["l_partkey", "l_orderkey"], _table(spark, sf_dir, "lineitem")
    return _against_exact(
        frequency.key_frequency(lineitem, columns), bounded.fast_distinct(lineitem, columns, 12), 12
    )


def hll_merge(spark, sf_dir):
    """The union of the sketches of two tables against the exact count over both."""
    named = [
        _table(spark, sf_dir, t).select(F.col(c).alias("custkey"))
        for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"))
    ]
    left, right = (bounded.bounded_state(df, ["custkey"], 12) for df in named)
    both = frequency.key_frequency(named[0].unionByName(named[1]), ["custkey"])
    return _against_exact(both, _estimated(bounded.merged_sketches(left, right)), 12)


def hll_builtin(spark, sf_dir):
    columns, lineitem = ["l_orderkey", "l_partkey", "l_shipdate"], _table(spark, sf_dir, "lineitem")
    return _against_exact(
        frequency.key_frequency(lineitem, columns), bounded.fast_distinct(lineitem, columns)
    )


def cms_cells(spark, sf_dir):
    return cms.scan_cells(_table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"])


def cms_weighted(spark, sf_dir):
    return cms.scan_cells(_table(spark, sf_dir, "documents"), ["source"], weight="n_chars")


def cms_total(spark, sf_dir):
    return cms.cms_total(cms_cells(spark, sf_dir))


def cms_estimate(spark, sf_dir):
    cells = cms.cms_cells(_custkeys(spark, sf_dir, "orders", "o_custkey"))
    return cms.cms_estimate(cells, _custkeys(spark, sf_dir, "customer", "c_custkey"))


def cms_merge(spark, sf_dir):
    shape = cms.CmsShape(0.01, 0.05)
    left = cms.cms_cells(_custkeys(spark, sf_dir, "orders", "o_custkey"), shape)
    right = cms.cms_cells(_custkeys(spark, sf_dir, "customer", "c_custkey"), shape)
    return cms.cms_merge(left, right, shape, shape)


# ---------------------------------------------------------------- scores and load


def column_scores(spark, sf_dir):
    return advisor.score(profiles.profile(_hot(spark, sf_dir), HOT_COLUMNS)).drop("position")


def score_ranking(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    rows = profiles.profile(documents, ["lang", "source", ("lang", "source"), "n_chars"])
    return advisor.rank(advisor.score(rows)).select("rank", "column", "composite_score")


def skew_band(spark, sf_dir):
    rows = advisor.flags(profiles.profile(_hot(spark, sf_dir), HOT_COLUMNS))
    return rows.withColumn("skew_ratio", F.round("skew_ratio", 6))


def report(spark, sf_dir):
    """The nested report as JSON, read back to one row per column."""
    nested = reports.report(_hot(spark, sf_dir), HOT_COLUMNS, WORKERS)
    text = reports.to_json(nested)
    back = text.select(F.from_json("report", nested.schema).alias("r")).select("r.*")
    zipped = F.arrays_zip("column_stats", "hints", "loads")
    per_column = back.select("scores", "schema_info", F.explode(zipped).alias("z"))
    name = F.col("z.column_stats.column")

    def own(array: str):
        """The column's element of an array that is in another order."""
        return F.filter(array, lambda s: s["column"] == name)[0]

    place = F.array_position(F.transform("scores", lambda s: s["column"]), name)
    return per_column.select(
        name.alias("column"),
        F.col("z.column_stats.total_rows").alias("total_rows"),
        own("scores")["composite_score"].alias("composite_score"),
        own("scores")["severity"].alias("severity"),
        place.cast("int").alias("place"),
        F.col("z.loads.load.total_rows").alias("load_rows"),
        (
            F.aggregate("z.loads.workers", F.lit(0).cast("bigint"), lambda a, w: a + w["assigned_rows"])
            == F.col("z.loads.load.total_rows")
        ).alias("load_adds_up"),
        F.size("z.loads.workers").alias("workers"),
        F.col("z.hints.explanation").alias("explanation"),
        own("schema_info")["type"].alias("type"),
    )


LOAD_COLUMNS = [*HOT_COLUMNS, "user_id"]


def _measured_load(spark, sf_dir):
    """Rows per hash partition of each column, counted over all rows."""
    return load.hash_bucket_load(_hot(spark, sf_dir), LOAD_COLUMNS, WORKERS)


def _hottest(spark, sf_dir):
    """(column, hottest): rows of the most frequent key of each column, null among the keys."""
    freq = frequency.key_frequency(_hot(spark, sf_dir), LOAD_COLUMNS)
    return freq.groupBy("column").agg(F.max("n").alias("hottest"))


def hash_bucket_load(spark, sf_dir):
    """Rows of every slot; each row is in one slot, and some slot holds all rows of the hottest key."""
    # At most WORKERS rows per column.
    own = Window.partitionBy("column")
    slots = _measured_load(spark, sf_dir).select(
        "column",
        "slot",
        "rows",
        F.sum("rows").over(own).alias("total_rows"),
        F.max("rows").over(own).alias("most"),
        F.col("slot").between(0, WORKERS - 1).alias("slots_in_range"),
        (F.size(F.collect_set("slot").over(own)) == F.count("slot").over(own)).alias("one_row_a_slot"),
    )
    # One row per column on the right.
    return slots.join(F.broadcast(_hottest(spark, sf_dir)), "column").select(
        "column",
        "slot",
        "rows",
        "total_rows",
        "slots_in_range",
        "one_row_a_slot",
        (F.col("most") >= F.col("hottest")).alias("holds_hottest"),
    )


def physical_load(spark, sf_dir):
    """The predicted hash load against the layout that a repartition really gives."""
    hot = _hot(spark, sf_dir)
    predicted = load.hash_bucket_load(hot, ["hot_key"], WORKERS).select(
        "slot", F.col("rows").alias("predicted")
    )
    laid_out = remedy.partition_layout(remedy.repartition_by_key(hot, ["hot_key"], WORKERS))
    actual = laid_out.select(F.col("partition").alias("slot"), F.col("rows").alias("actual"))
    differs = F.coalesce("predicted", F.lit(0)) != F.coalesce("actual", F.lit(0))
    # At most one row per slot on both sides.
    return predicted.join(actual, "slot", "full").agg(
        F.sum("predicted").alias("total_rows"),
        F.sum(differs.cast("bigint")).alias("slots_that_differ"),
    )


def load_report(spark, sf_dir):
    """All figures by value, and whether they follow from each other."""
    rows = load.load_report(_measured_load(spark, sf_dir), WORKERS)
    near = lambda a, b: F.abs(a - b) < 1e-9
    straggler = F.col("straggler_worker_id")
    # One row per column on both sides.
    return rows.join(F.broadcast(_hottest(spark, sf_dir)), "column").select(
        "column",
        "num_workers",
        "total_rows",
        "max_rows",
        F.round("mean_rows", 9).alias("mean_rows"),
        F.round("slowdown_factor", 9).alias("slowdown_factor"),
        "straggler_worker_id",
        F.round("idle_fraction", 9).alias("idle_fraction"),
        ((F.col("max_rows") >= F.col("hottest")) & (F.col("max_rows") <= F.col("total_rows"))).alias("max_in_range"),
        near(F.col("slowdown_factor"), F.col("max_rows") / F.col("mean_rows")).alias("slowdown_agrees"),
        near(F.col("idle_fraction"), 1 - 1 / F.col("slowdown_factor")).alias("idle_agrees"),
        ((straggler >= 0) & (straggler < WORKERS)).alias("straggler_in_range"),
    )


def worker_load(spark, sf_dir):
    """Every worker's load; a column's add up, one straggles, and none is idle but by its lack of rows."""
    rows = load.worker_load(_measured_load(spark, sf_dir), WORKERS)
    # WORKERS rows per column.
    own = Window.partitionBy("column")
    total, most = F.sum("assigned_rows").over(own), F.max("assigned_rows").over(own)
    fullest = F.max_by("is_straggler", F.struct("assigned_rows", -F.col("worker_id"))).over(own)
    return rows.select(
        "column",
        "worker_id",
        "assigned_rows",
        "is_straggler",
        "idle_rows",
        F.size(F.collect_set("worker_id").over(own)).cast("bigint").alias("workers"),
        total.alias("total_rows"),
        F.count_if("is_straggler").over(own).alias("stragglers"),
        fullest.alias("fullest_straggles"),
        (F.sum("idle_rows").over(own) == most * WORKERS - total).alias("idle_agrees"),
    )


def top_key_packing(spark, sf_dir):
    """Where the balanced layout puts keys, measured: rows of each, and whether it was cut."""
    laid_out = load.balanced_repartition(_hot(spark, sf_dir), ["hot_key"], WORKERS)
    places = laid_out.groupBy("hot_key", F.spark_partition_id().alias("slot")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return places.groupBy(F.col("hot_key").cast("string").alias("key")).agg(
        F.sum("rows").alias("rows"), (F.count("slot") > 1).alias("is_cut")
    )


def _evenness(laid_out: DataFrame, n: int, bound: float) -> DataFrame:
    """One row: partitions with rows, rows, and whether the largest is within ``bound`` of the mean."""
    layout = remedy.partition_layout(laid_out)
    return layout.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.sum("rows").alias("total_rows"),
        (F.max("rows") <= bound * F.sum("rows") / n).alias("even"),
    )


def balanced_repartition(spark, sf_dir):
    """The balanced layout is even; that of the same rows hashed by key is not."""
    hot = _hot(spark, sf_dir)
    ways = {
        "balanced": load.balanced_repartition(hot, ["hot_key"], WORKERS),
        "hashed": remedy.repartition_by_key(hot, ["hot_key"], WORKERS),
    }
    rows = [_evenness(df, WORKERS, 1.1).withColumn("layout", F.lit(w)) for w, df in ways.items()]
    return rows[0].unionByName(rows[1]).select("layout", "total_rows", "even")


def balanced_rows(spark, sf_dir):
    """The balanced layout keeps every row."""
    laid_out = load.balanced_repartition(_hot(spark, sf_dir), ["hot_key"], WORKERS)
    return laid_out.select("event_id", F.col("hot_key").cast("bigint").alias("hot_key"), "value")


# ---------------------------------------------------------------- remedies


def salt_column(spark, sf_dir):
    salted = remedy.salt_column(
        _hot(spark, sf_dir), "hot_key", 8, salt=F.pmod(F.col("event_id"), F.lit(8))
    )
    return salted.select("event_id", "hot_key_salted")


def salted_row_totals(spark, sf_dir):
    """Rows per key after salting by row identity: unchanged by the salt."""
    salted = remedy.salt_column(_hot(spark, sf_dir), "hot_key", 8)
    return salted.groupBy(F.substring_index("hot_key_salted", "_", 1).alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )


def salted_aggregate(spark, sf_dir):
    return remedy.salted_aggregate(
        _hot(spark, sf_dir),
        ["hot_key"],
        {
            "n": ("count", "*"),
            "n_values": ("count", "value"),
            "id_sum": ("sum", "event_id"),
            "value_min": ("min", "value"),
            "value_max": ("max", "value"),
            "id_avg": ("avg", "event_id"),
            "types": ("approx_distinct", "event_type"),
            "exact_types": ("count_distinct", "event_type"),
            "value_median": ("median", "value"),
            "props_list": ("collect_list", "event_type"),
        },
        parts=20,
    ).withColumn("props_list", F.array_join(F.array_sort("props_list"), ","))


def salted_join(spark, sf_dir):
    events = _hot(spark, sf_dir).select("event_id", F.col("hot_key").alias("c_custkey"))
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return remedy.salted_join(events, customers, ["c_custkey"], "left", hot_share=50)


def salted_outer_join(spark, sf_dir):
    """Events without a customer, customers without an event, and a null key on both sides."""
    events = _hot(spark, sf_dir).select("event_id", F.col("hot_key").alias("c_custkey"))
    customers = _table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 10 > 0, F.col("c_custkey")).alias("c_custkey"), "c_name"
    )
    return remedy.salted_join(events, customers, ["c_custkey"], "full", hot_share=50)


def salted_apply(spark, sf_dir):
    """Own functions per key, hot keys in pieces: rows, and the three largest values."""
    rows = _hot(spark, sf_dir).select(
        F.coalesce(F.col("hot_key").cast("string"), F.lit("none")).alias("key"), "event_id", "value"
    )

    def partial(piece):
        return piece.nlargest(3, "value")[["key", "value"]].assign(n=len(piece) / min(3, len(piece)))

    def merge(parts):
        best = ",".join(f"{v:.6f}" for v in parts["value"].nlargest(3))
        return parts.head(1)[["key"]].assign(n=round(parts["n"].sum()), best=best)

    schemas = "key string, value double, n double", "key string, n bigint, best string"
    return remedy.salted_apply(rows, ["key"], partial, merge, *schemas, parts=20, identity=["event_id"])


def repartition_by_key(spark, sf_dir):
    """Partitions that hold rows of a key, per key, and its rows."""
    laid_out = remedy.repartition_by_key(_table(spark, sf_dir, "orders"), ["o_custkey"], 16)
    return (
        laid_out.select("o_custkey", F.spark_partition_id().alias("p"))
        .groupBy("o_custkey")
        .agg(F.count_distinct("p").alias("partitions"), F.count(F.lit(1)).alias("n"))
    )


# ---------------------------------------------------------------- batches and streams


def batch_snapshots(spark, sf_dir):
    hot = _hot(spark, sf_dir).withColumn("batch_id", F.expr("event_id div 1000"))
    return _snapshots(hot, HOT_COLUMNS)


def unique_key_snapshots(spark, sf_dir):
    """Snapshots of a column without a repeated key: all ranks are ties."""
    events = _table(spark, sf_dir, "events")
    return _snapshots(events.withColumn("batch_id", F.expr("event_id div 1000")), ["event_id"])


def _snapshots(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = snapshots.batch_snapshots(df, columns, "batch_id")
    return rows.select(
        "column",
        "batch",
        "batch_count",
        "total_rows",
        "null_count",
        F.round("skew_ratio", 6).alias("skew_ratio"),
        "max_count",
        "top_rows",
        _joined("partition_counts").alias("partition_counts"),
    )


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream, with ``hot_key`` and a skewed key of few values."""
    events = _table(spark, sf_dir, "events")
    path = staging.stage_parquet(events, 2)  # two micro-batches
    stream = streams.stream_files(spark, path, events.schema)
    missing, hot = F.col("event_id") % 20 == 0, F.col("event_id") % 5 < 2
    return stream.withColumns(
        {
            "hot_key": F.when(missing, None).when(hot, F.lit(0)).otherwise(F.col("user_id")),
            "hot_prop": _hot_prop(),
        }
    )


def _finished(spark, sf_dir, start, columns: list[str], name: str) -> Versions:
    versions = Versions(fresh_dir(spark, name))
    start(_event_stream(spark, sf_dir), columns, versions).awaitTermination()
    return versions


def stream_profile(spark, sf_dir):
    versions = _finished(spark, sf_dir, streams.start_profile, HOT_COLUMNS, "stream")
    return _flat_profile(versions.latest(spark)).drop("batch_count")


BOUNDED_CAP = 40


def _bounded_stream(spark, sf_dir, columns: list[str], cap: int = BOUNDED_CAP) -> Versions:
    versions = Versions(fresh_dir(spark, "bounded"))
    start = streams.start_bounded_profile(
        _event_stream(spark, sf_dir), columns, versions, cap=cap
    )
    start.awaitTermination()
    return versions


def _bounded_profile(spark, sf_dir, columns: list[str], cap: int) -> DataFrame:
    """The snapshot of a stream with ``cap`` counters per column, against the true counts.

    What depends on counters is given by value where none was cut.
    """
    snapshot = _bounded_stream(spark, sf_dir, columns, cap).latest(spark)
    hot = _hot(spark, sf_dir).withColumn("hot_prop", _hot_prop())
    true = frequency.present_keys(frequency.key_frequency(hot, columns)).select(
        "column", "key", F.col("n").alias("true_n")
    )
    counters = snapshot.select("column", "count_error", F.inline("top_keys"))
    over = F.col("true_n") - F.col("count")
    within = (
        true.join(F.broadcast(counters), ["column", "key"], "left")
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("distinct_keys"),
            F.bool_and((over >= 0) & (over <= F.col("count_error"))).alias("within_error"),
        )
    )
    first, distinct = F.get("top_keys", 0), F.col("distinct_keys")
    leader = F.when(first["count"] * 10 > F.col("total_rows"), first["key"])
    flat = _flat_profile(snapshot)
    more = snapshot.select("column", "count_error", leader.alias("leader"))
    whole = lambda name: F.when(F.col("count_error") == 0, F.col(name)).alias(name)
    # One row per column on all sides.
    return flat.join(F.broadcast(more), "column").join(F.broadcast(within), "column").select(
        "column",
        F.lit(cap).alias("cap"),
        "total_rows",
        "null_count",
        "null_fraction",
        "hll_error",
        (F.abs(F.col("cardinality_estimate") - distinct) <= 5 * F.col("hll_error") * distinct).alias(
            "cardinality_near"
        ),
        *[whole(c) for c in ("cardinality_estimate", "skew_ratio", "top_keys", "partition_counts")],
        (F.col("count_error") * (cap + 1) <= F.col("total_rows")).alias("error_in_bound"),
        "within_error",
        "leader",
    )


def stream_bounded_state(spark, sf_dir):
    """The snapshots of two streams: of fewer keys than counters, and of far more.

    Row and null counts are exact, the error a snapshot carries is within its bound, the top keys'
    true counts are within that error, and a key with a tenth of the rows leads. Columns that fit
    have their whole profile, exact.
    """
    fits = _bounded_profile(spark, sf_dir, ["hot_prop", "event_type"], summary.CAP)
    return fits.unionByName(_bounded_profile(spark, sf_dir, LOAD_COLUMNS, BOUNDED_CAP))


def stream_bounds(spark, sf_dir):
    """Every key of the table against the counters of the state, held or not."""
    columns = ["user_id", "event_type"]
    versions = _bounded_stream(spark, sf_dir, columns)
    state = versions.state(spark, versions.last_batch(spark))
    kept = streams.keys_of_state(state)
    error = streams.errors_of_state(state).withColumnRenamed("count_error", "bound")
    freq = frequency.key_frequency(_table(spark, sf_dir, "events"), columns)
    both = frequency.present_keys(freq).withColumnRenamed("n", "true_n").join(
        kept.drop("count_error"), ["column", "key"], "left"
    ).join(F.broadcast(error), "column")
    low = F.coalesce("n", F.lit(0))
    within = (low <= F.col("true_n")) & (F.col("true_n") <= low + F.col("bound"))
    return both.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.sum("true_n").alias("n_rows"),
        # By value while no counter was cut; it then is the number of keys.
        F.when(F.max("bound") == 0, F.count("n")).alias("tracked"),
        F.count_if(within).alias("keys_within"),
        (F.count("n") <= BOUNDED_CAP).alias("held_in_cap"),
        F.bool_and(within).alias("within"),
    )


def stream_summary(spark, sf_dir):
    """Scores of everything a stream has read, and its load against that of the same rows as a table."""
    versions = _finished(spark, sf_dir, streams.start_profile, HOT_COLUMNS, "summary")
    hot = _hot(spark, sf_dir)
    done = streams.final_summary(spark, versions, tables.schema_info(hot), WORKERS)
    measured = load.load_arrays(load.hash_bucket_load(hot, HOT_COLUMNS, WORKERS), WORKERS)
    scores, loads = done.select(F.inline("scores")), done.select(F.inline("loads"))
    assigned = F.transform("workers", lambda w: w["assigned_rows"])
    # One row per column on all sides.
    return scores.join(F.broadcast(loads), "column").join(F.broadcast(measured), "column").select(
        *scores.columns,
        F.col("load.total_rows").alias("load_rows"),
        F.size("workers").alias("workers"),
        (assigned == F.col("loads")).alias("load_as_table"),
    )


def heavy_hitter_summary(spark, sf_dir):
    """A summary of few counters per part of the table, merged: its bound, and all keys within it."""
    lineitem, columns, cap = _table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], 60
    parts = [lineitem.where(F.col("l_linenumber") % 3 == i) for i in range(3)]
    each = [summary.summarize(part, columns, cap) for part in parts]
    merged = summary.merge(each[0].unionByName(each[1]).unionByName(each[2]), cap)
    counters = merged.select("column", F.inline("keys"))
    bounds = merged.select("column", "rows", "error", F.size("keys").alias("held"))
    freq = frequency.present_keys(frequency.key_frequency(lineitem, columns))
    both = freq.select("column", "key", F.col("n").alias("true_n")).join(
        counters, ["column", "key"], "left"
    ).join(F.broadcast(bounds), "column")
    lost = F.col("true_n") - F.coalesce("n", F.lit(0))
    return both.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.max("rows").alias("rows"),
        (F.max("held") <= cap).alias("held_in_cap"),
        (F.max("error") * (cap + 1) <= F.max("rows")).alias("error_in_bound"),
        F.bool_and((lost >= 0) & (lost <= F.col("error"))).alias("within_error"),
    )


QUERIES = [
    parquet_scan,
    schema_info,
    csv_roundtrip,
    arrow_roundtrip,
    zipf_table,
    partitioned_write,
    long_form,
    key_frequency,
    null_counts,
    top_k_keys,
    approx_top_k,
    refined_top_k,
    footer_counts,
    heavy_keys,
    skew_ratio,
    entropy,
    normalized_entropy,
    column_profile,
    one_column_profile,
    bounded_profile,
    composite_key_profile,
    composite_key_search,
    not_null_profile,
    hll_registers,
    hll_estimate,
    hll_merge,
    hll_builtin,
    cms_cells,
    cms_weighted,
    cms_total,
    cms_estimate,
    cms_merge,
    column_scores,
    score_ranking,
    skew_band,
    report,
    hash_bucket_load,
    physical_load,
    load_report,
    worker_load,
    top_key_packing,
    balanced_repartition,
    balanced_rows,
    salt_column,
    salted_row_totals,
    salted_aggregate,
    salted_join,
    salted_outer_join,
    salted_apply,
    repartition_by_key,
    batch_snapshots,
    unique_key_snapshots,
    stream_profile,
    stream_bounded_state,
    stream_bounds,
    stream_summary,
    heavy_hitter_summary,
]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: profile and score candidate keys of the events table."""
    hot = _hot(spark, "/root/testdata/sf0.001")
    return advisor.rank(advisor.scored(profiles.profile(hot, [*HOT_COLUMNS, "user_id"])))


def _optional(module: str):
    """A module of the training-text part, or None where it, or a package that it needs, is not installed."""
    try:
        return importlib.import_module(module)
    except ImportError as e:
        if e.name not in ("corpus_pipeline", "keybalance.llm"):
            warnings.warn(f"{module} left out: {e}", stacklevel=2)
        return None


LLM = _optional("keybalance.llm") and _optional("keybalance.llm.queries")
LLM_SQL = LLM and _optional("keybalance.llm.oracles")
PIPELINE = LLM and _optional("corpus_pipeline")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each callable takes (spark, sf_dir)."""
    found = {q.__name__: q for q in QUERIES}
    if LLM:
        found |= {q.__name__: q for q in LLM.QUERIES}
    if PIPELINE:
        found["pipeline"] = PIPELINE.run
    return found


def oracle_sql() -> dict[str, str]:
    """The same results in SQL; see ``oracle_queries.py``."""
    from oracle_queries import ORACLES

    found = dict(ORACLES)
    if LLM_SQL:
        found |= LLM_SQL.ORACLES
    if PIPELINE and PIPELINE.ORACLE_SQL:
        found["pipeline"] = PIPELINE.ORACLE_SQL
    return found
