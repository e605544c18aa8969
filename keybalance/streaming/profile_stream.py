"""Profile kept up to date by Structured Streaming, exact or with bounded state."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from keybalance.functions.keys import Candidate, candidate_name, key_text, parse_candidates
from keybalance.operators.bounded import SKETCH_BITS, sketch_estimate, standard_error
from keybalance.operators.cms import CmsShape, cms_cells
from keybalance.operators.frequency import TOP_K, key_frequency, top_keys
from keybalance.operators.heavy import hash_bucket
from keybalance.operators.load import check_slots, load_arrays
from keybalance.operators.profile import (
    assemble,
    profile_frequency,
    requested_columns,
    with_top_keys,
)
from keybalance.operators.summary import CAP, cuts, held, leading
from keybalance.plans.report import column_report, nested_report
from keybalance.streaming.versions import Versions, state_rows

#: Hash buckets whose rows a stream counts. A load over n workers needs n to divide it:
#: 1 to 10, 12, 14 to 16, 18, 20, 24, 30, 32, 40, 48, 60, 64, 80, 96, 120, 160, 192, 240 and more.
LOAD_BUCKETS = 20_160


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    files_per_trigger: int = 1,
    source: str = "parquet",
) -> DataFrame:
    """Stream of the files under ``path``; the files of one trigger are one micro-batch."""
    return (
        spark.readStream.format(source)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )


def _long_rows(
    df: DataFrame, candidates: list[Candidate], buckets: int, with_total: bool
) -> DataFrame:
    """(column, key, slot) rows: one per candidate with its key, and one with its hash bucket.

    The bucket is the one that ``repartition`` would use, nulls included. ``with_total``
    adds a row without a column, which counts all rows.
    """
    no_key, no_slot = F.lit(None).cast("string"), F.lit(None).cast("int")
    row = lambda column, key, slot: F.struct(
        column.alias("column"), key.alias("key"), slot.alias("slot")
    )
    rows = []
    for c in candidates:
        name, parts = F.lit(candidate_name(c)), (c,) if isinstance(c, str) else c
        rows.append(row(name, key_text(df, c), no_slot))
        rows.append(row(name, no_key, hash_bucket(parts, buckets)))
    if with_total:
        rows.append(row(no_key, no_key, no_slot))
    return df.select(F.inline(F.array(*rows)))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("column").isNotNull() & F.col("slot").isNull()).drop("slot")


def _loads(rows: DataFrame) -> DataFrame:
    """State rows of the counts per hash bucket."""
    return state_rows(rows.where(F.col("slot").isNotNull()), "load", slot="slot")


def _grown(changed: DataFrame, names: list[str], b: int) -> DataFrame:
    """State rows of changed counts: row counts, null counts, distinct sketches, loads.

    The null column's count is the number of rows, the same for all columns.
    """
    total = F.max(F.when(F.col("column").isNull(), F.col("n")))
    rows = changed.agg(total.alias("n")).where(F.col("n").isNotNull())
    totals = rows.select(F.explode(F.array(*[F.lit(c) for c in names])).alias("column"), "n")
    keyed = _keyed(changed).groupBy("column").agg(
        F.max(F.when(F.col("key").isNull(), F.col("n"))).alias("nulls"),
        F.hll_sketch_agg("key", b).alias("sketch"),
    )
    return (
        state_rows(totals, "rows")
        .unionByName(state_rows(keyed.where("nulls > 0"), "nulls", n="nulls"))
        .unionByName(state_rows(keyed, "distinct", n=None, sketch="sketch"))
        .unionByName(_loads(changed))
    )


def _merged(rows: DataFrame, count) -> DataFrame:
    """State rows of one place merged: counts by ``count``, sketches by their union."""
    return rows.groupBy("column", "kind", "lane", "slot", "key").agg(
        count("n").alias("n"), F.hll_union_agg("sketch").alias("__union"),
        F.count("sketch").alias("__sketches"),
    ).withColumn("sketch", F.when(F.col("__sketches") > 0, F.col("__union"))).drop(
        "__union", "__sketches"
    )


def _newest_top(counts: DataFrame, k: int) -> DataFrame:
    """Top k keys of rows in which a key can occur twice, with an older and a newer count.

    Counts only grow, so the larger one is the newer. The first 2 k rows hold the
    first k keys; they are already partitioned by column, so the rest is local.
    """
    leading = top_keys(counts, 2 * k).groupBy("column", "key").agg(F.max("n").alias("n"))
    return top_keys(leading, k)


def profile_of_state(
    state: DataFrame, candidates: list[Candidate], k: int, b: int, batch_count: int
) -> DataFrame:
    """Profile rows from a state table, with ``count_error``: 0 where counts are exact."""
    names = [candidate_name(c) for c in candidates]

    def of_kind(kind: str, value):
        return F.when(F.col("kind") == kind, value)

    n = F.col("n")
    blank = requested_columns(state, names).withColumn("n", F.lit(0))
    totals = (
        state.where(F.col("kind").isin("rows", "nulls", "distinct"))
        .unionByName(state_rows(blank, "rows"))
        .groupBy("column")
        .agg(
            F.max(of_kind("rows", n)).alias("total_rows"),
            F.coalesce(F.max(of_kind("nulls", n)), F.lit(0)).alias("null_count"),
            F.max(of_kind("distinct", F.col("sketch"))).alias("__sketch"),
        )
        .withColumn("cardinality_estimate", sketch_estimate("__sketch"))
        .withColumn("batch_count", F.lit(batch_count).cast("bigint"))
    )
    keys = state.where(F.col("kind") == "key").select("column", "key", "n")
    profiles = assemble(with_top_keys(totals, top_keys(keys, k)), candidates, standard_error(b))
    # One row per column on both sides.
    return profiles.join(F.broadcast(errors_of_state(state)), "column", "left").withColumn(
        "count_error", F.coalesce("count_error", F.lit(0).cast("bigint"))
    )


def errors_of_state(state: DataFrame) -> DataFrame:
    """(column, count_error): what a key's true count can lie above its counter at most."""
    return state.where(F.col("kind") == "error").select("column", F.col("n").alias("count_error"))


def _save_blank(stream: DataFrame, candidates: list[Candidate], versions: Versions, k: int) -> None:
    """What a summary shows until the first micro-batch."""
    nothing = stream.sparkSession.createDataFrame([], stream.schema)
    blank = profile_frequency(key_frequency(nothing, candidates), candidates, k)
    versions.save_blank(blank.withColumn("count_error", F.lit(0).cast("bigint")))


def _start(
    rows: DataFrame,
    mode: str,
    on_batch: Callable[[DataFrame, int], None],
    versions: Versions,
    trigger: dict,
) -> StreamingQuery:
    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", versions.checkpoint)
        .trigger(**trigger)
        .foreachBatch(on_batch)
        .start()
    )


def start_profile(
    stream: DataFrame,
    columns: str | Iterable[Candidate],
    versions: Versions,
    k: int = TOP_K,
    b: int = SKETCH_BITS,
    buckets: int = LOAD_BUCKETS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Exact running profile; writes a snapshot per micro-batch.

    The key counts live in the state store. A micro-batch emits only the counts it
    changed: as counts never fall, the new top k are among the changed keys and the
    old top k, and sketches, row, null and bucket counts only grow. So a snapshot costs as
    much as its micro-batch, not as much as the state. Use ``start_bounded_profile``
    when the distinct keys themselves are too many to keep.
    """
    candidates = parse_candidates(columns, stream.columns)
    names = [candidate_name(c) for c in candidates]
    _save_blank(stream, candidates, versions, k)
    counts = (
        _long_rows(stream, candidates, buckets, with_total=True)
        .groupBy("column", "key", "slot")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def on_batch(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        changed = changed.persist()  # every further read would run the stateful plan again
        try:
            keyed = _keyed(changed)
            before = versions.previous(spark, batch_id)
            old_keys = before.where(F.col("kind") == "key").select("column", "key", "n")
            top = _newest_top(keyed.unionByName(old_keys), k)
            grown = _merged(
                before.where(F.col("kind") != "key").unionByName(_grown(changed, names, b)), F.max
            )
            kept = grown.unionByName(state_rows(top, "key", key="key"))
            state = versions.save_state(kept, batch_id)
            versions.save_snapshot(
                profile_of_state(state, candidates, k, b, batch_id + 1), batch_id
            )
        finally:
            changed.unpersist()

    return _start(counts, "update", on_batch, versions, trigger or {"availableNow": True})


def start_bounded_profile(
    stream: DataFrame,
    columns: str | Iterable[Candidate],
    versions: Versions,
    k: int = TOP_K,
    cap: int = CAP,
    b: int = SKETCH_BITS,
    shape: CmsShape = CmsShape(),
    buckets: int = LOAD_BUCKETS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Running profile whose state does not grow with the keys.

    It keeps two sketches, the rows per hash bucket and a heavy-hitter summary of ``cap`` counters
    per column (see ``operators.summary``). A micro-batch's counts merge into the summary, so a
    counter is a lower bound, and no true count lies above it by more than ``count_error`` of
    the snapshot. That is at most rows / (cap + 1), and 0 while a column has at most ``cap`` distinct
    keys. Use ``start_profile`` for exact counts.
    """
    candidates = parse_candidates(columns, stream.columns)
    _save_blank(stream, candidates, versions, k)
    rows = _long_rows(stream, candidates, buckets, with_total=False)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = versions.previous(spark, batch_id)
        counters = before.where(F.col("kind") == "key")
        nothing = F.lit(0).cast("bigint")
        # The counters join the count of the batch's own rows: one shuffle for both.
        freq = (
            batch.select("column", "key", "slot", F.lit(1).cast("bigint").alias("n"), nothing.alias("kept"))
            .unionByName(
                counters.select(
                    "column", "key", F.lit(None).cast("int").alias("slot"), nothing.alias("n"), F.col("n").alias("kept")
                )
            )
            .groupBy("column", "key", "slot")
            .agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
            .persist()
        )
        try:
            seen = _keyed(freq.where(F.col("n") > 0)).select("column", "key", "n")
            nulls = F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0))
            counted = seen.groupBy("column").agg(
                F.sum("n").alias("rows"),
                nulls.alias("nulls"),
                F.hll_sketch_agg("key", b).alias("sketch"),
            )
            both = _keyed(freq).select("column", "key", (F.col("n") + F.col("kept")).alias("n"))
            lead = leading(both, cap)
            added = (
                state_rows(cms_cells(seen, shape), "cell", lane="row", slot="cell", n="cnt")
                .unionByName(state_rows(counted, "rows", n="rows"))
                .unionByName(state_rows(counted, "nulls", n="nulls"))
                .unionByName(state_rows(counted, "distinct", n=None, sketch="sketch"))
                .unionByName(state_rows(cuts(lead), "error", n="cut"))
                .unionByName(_loads(freq))
                .unionByName(before.where(F.col("kind") != "key"))
            )
            kept = state_rows(held(lead), "key", key="key")
            state = versions.save_state(_merged(added, F.sum).unionByName(kept), batch_id)
            versions.save_snapshot(
                profile_of_state(state, candidates, k, b, batch_id + 1), batch_id
            )
        finally:
            freq.unpersist()

    return _start(rows, "append", on_batch, versions, trigger or {"availableNow": True})


def cells_of_state(state: DataFrame) -> DataFrame:
    """The Count-Min cells kept by the bounded profile."""
    return state.where(F.col("kind") == "cell").select(
        "column", F.col("lane").alias("row"), F.col("slot").alias("cell"), F.col("n").alias("cnt")
    )


def keys_of_state(state: DataFrame) -> DataFrame:
    """(column, key, n, count_error): the counters; a true count is from n to n + count_error.

    A key without a counter occurred count_error times at most.
    """
    keys = state.where(F.col("kind") == "key").select("column", "key", "n")
    # One row per column on the right.
    return keys.join(F.broadcast(errors_of_state(state)), "column", "left").withColumn(
        "count_error", F.coalesce("count_error", F.lit(0).cast("bigint"))
    )


def load_of_state(state: DataFrame, workers: int, buckets: int = LOAD_BUCKETS) -> DataFrame:
    """(column, slot, rows): all rows read so far, as ``repartition(workers, column)`` would spread them."""
    if buckets % check_slots(workers):
        raise ValueError(f"the stream counts rows in {buckets} buckets, which {workers} does not divide")
    loads = state.where(F.col("kind") == "load")
    slot = (F.col("slot") % workers).alias("slot")
    return loads.groupBy("column", slot).agg(F.sum("n").alias("rows"))


def final_summary(
    spark: SparkSession,
    versions: Versions,
    schema: dict[str, str],
    workers: int = 8,
    buckets: int = LOAD_BUCKETS,
) -> DataFrame:
    """The nested report of everything that a stream has read.

    A stream keeps no rows, but it has counted all of them per hash bucket: the load is that
    of the whole table, nulls and rare keys included.
    """
    last = versions.last_batch(spark)
    loads = load_of_state(versions.state(spark, -1 if last is None else last), workers, buckets)
    return nested_report(
        column_report(versions.latest(spark), workers, load_arrays(loads, workers)), schema
    )
