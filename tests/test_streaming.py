import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keybalance.operators import cms, load
from keybalance.operators.frequency import key_frequency
from keybalance.operators.profile import profile
from keybalance.sources import staging
from keybalance.streaming import profile_stream as S
from keybalance.streaming import snapshots
from keybalance.streaming.snapshots import batch_snapshots
from keybalance.streaming.versions import Versions, state_rows
from keybalance.workdir import child_names, fresh_dir

COLUMNS = ["user_id", "event_type"]
COMPARED = [
    "column", "total_rows", "null_count", "cardinality_estimate", "skew_ratio", "top_keys",
    "partition_counts",
]


def picked(df):
    return df.select(*COMPARED).orderBy("column").collect()


def brute(rows, batch, k):
    """Top k of the keys in all rows up to a batch."""
    counts = Counter(key for b, key in rows if b <= batch and key is not None)
    return sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:k]


@pytest.mark.parametrize("seed, block", [(0, 256), (1, 3), (2, 1), (3, 5)])
def test_snapshots_against_counting(spark, seed, block, monkeypatch):
    monkeypatch.setattr(snapshots, "BLOCK", block)
    rng = random.Random(seed)
    # Keys come and go, batches are sparse, and ranks change over time.
    batches = sorted(rng.sample(range(-5, 200), 12))
    rows = []
    for i, b in enumerate(batches):
        for _ in range(rng.randint(1, 40)):
            key = rng.choice([None, f"a{i}", f"k{rng.randint(0, 12)}", f"z{int(rng.paretovariate(1))}"])
            rows.append((b, key))
    k = rng.choice([1, 3, 5])
    df = spark.createDataFrame(rows, "b int, k string")
    got = {r.batch: r for r in batch_snapshots(df, "k", "b", k).collect()}
    assert sorted(got) == sorted({b for b, _ in rows})
    for place, b in enumerate(sorted(got), start=1):
        row = got[b]
        assert [tuple(t) for t in row.top_keys] == brute(rows, b, k)
        assert row.total_rows == sum(1 for x, _ in rows if x <= b)
        assert row.null_count == sum(1 for x, key in rows if x <= b and key is None)
        assert row.batch_count == place


def test_snapshots_accumulate(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "b int, k string")
    rows = batch_snapshots(df, "k", "b").orderBy("batch").collect()
    assert [r.total_rows for r in rows] == [2, 4]
    assert rows[1].partition_counts == [2, 1, 1]


def test_snapshots_of_null_batches(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "b int, k string")
    first, second = batch_snapshots(df, "k", "b").orderBy("batch").collect()
    assert (first.null_count, first.top_keys, first.skew_ratio) == (1, [], 1.0)
    assert (second.null_count, second.partition_counts) == (1, [1])


def test_snapshots_of_unique_keys_keep_k_keys_a_batch(spark):
    df = spark.range(5000).select((F.col("id") % 25).cast("int").alias("b"), F.col("id").alias("k"))
    freq = key_frequency(df, "k", by="b").withColumnRenamed("b", "batch")
    places = spark.range(25).select(F.lit("k").alias("column"), F.col("id").cast("int").alias("batch"), F.col("id").cast("int").alias("place"))
    running = snapshots.running_counts(freq, places)
    assert snapshots.leading_counts(running, 4).count() == 4 * 25
    assert snapshots.block_ends(running, 4).count() == 4
    rows = batch_snapshots(df, "k", "b", 4).orderBy("batch").collect()
    assert [r.total_rows for r in rows] == [200 * (i + 1) for i in range(25)]
    keys = [str(i) for i in range(5000)]
    for r in rows:
        assert [t.key for t in r.top_keys] == sorted(k for k in keys if int(k) % 25 <= r.batch)[:4]


def test_snapshots_of_many_batches_join_on_equal_keys_only(spark):
    """2,000 batches in 8 blocks; no batch is compared with all others."""
    df = spark.range(20_000).select(
        F.expr("id div 10").alias("b"), F.expr("cast(pow(id * 7919 % 1000, 2) / 5000 as int)").alias("k")
    )
    found = batch_snapshots(df, "k", "b", 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    rows = {r.batch: [tuple(t) for t in r.top_keys] for r in found.collect()}
    keys = [r.k for r in df.orderBy("b").collect()]
    counts = Counter()
    for b in range(2000):
        counts.update(str(k) for k in keys[10 * b : 10 * b + 10])
        assert rows[b] == sorted(counts.items(), key=lambda kn: (-kn[1], kn[0]))[:3]


def test_snapshots_need_a_batch_id(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "b int, k string")
    with pytest.raises(Exception, match="batch id is null"):
        batch_snapshots(df, "k", "b")


@pytest.fixture(scope="module")
def staged(events):
    key = F.when(F.col("event_id") % 9 > 0, F.col("user_id"))
    df = events.withColumn("user_id", key)
    return df, staging.stage_parquet(df, 4)


def finished(spark, staged, start, **options):
    df, path = staged
    versions = Versions(fresh_dir(spark, "stream"))
    start(S.stream_files(spark, path, df.schema), COLUMNS, versions, **options).awaitTermination()
    return versions


def test_stream_ends_at_the_batch_profile(spark, staged):
    versions = finished(spark, staged, S.start_profile)
    assert picked(versions.latest(spark)) == picked(profile(staged[0], COLUMNS))
    per_batch = versions.all_snapshots(spark).where("column = 'event_type'").orderBy("batch_id")
    rows = per_batch.collect()
    assert [r.batch_count for r in rows] == [1, 2, 3, 4]
    totals = [r.total_rows for r in rows]
    assert totals == sorted(totals) and totals[-1] == staged[0].count()


def test_every_snapshot_is_the_profile_so_far(spark, staged):
    versions = finished(spark, staged, S.start_profile, k=3)
    log = spark.read.json(f"{versions.checkpoint}/sources/0").where("path IS NOT NULL").collect()
    files = [r.path for r in sorted(log, key=lambda r: r.batchId)]
    for batch_id in range(len(files)):
        so_far = spark.read.parquet(*files[: batch_id + 1])
        snapshot = spark.read.parquet(f"{versions.snapshots}/batch_id={batch_id}")
        assert picked(snapshot) == picked(profile(so_far, COLUMNS, k=3))


def test_bounded_stream_is_exact_within_cap(spark, staged):
    versions = finished(spark, staged, S.start_bounded_profile)
    assert picked(versions.latest(spark)) == picked(profile(staged[0], COLUMNS))
    state = versions.state(spark, versions.last_batch(spark))
    freq = key_frequency(staged[0], COLUMNS)
    order = ["column", "row", "cell", "cnt"]
    assert sorted(S.cells_of_state(state).select(*order).collect()) == sorted(
        cms.cms_cells(freq).select(*order).collect()
    )
    assert S.keys_of_state(state).where("count_error > 0").count() == 0
    assert [r.count_error for r in versions.latest(spark).collect()] == [0, 0]


def in_batches(spark, batches):
    """A stream with one micro-batch per list of keys, in order."""
    path = fresh_dir(spark, "ordered")
    for i, batch in enumerate(batches):
        spark.createDataFrame([(k,) for k in batch], "user_id string").coalesce(1).write.parquet(
            f"{path}/part={i}"
        )
    schema = spark.createDataFrame([("x",)], "user_id string").schema
    return S.stream_files(spark, f"{path}/*", schema)


def merged(batches, cap):
    """Counters and error after each batch, one batch merged at a time."""
    counters, error = Counter(), 0
    for batch in batches:
        counters.update(k for k in batch if k is not None)
        sizes = sorted(counters.values(), reverse=True)
        cut = sizes[cap] if len(sizes) > cap else 0
        error += cut
        counters = Counter({k: n - cut for k, n in counters.items() if n > cut})
    return counters, error


@pytest.mark.parametrize("seed, cap", [(1, 2), (2, 5), (3, 11)])
def test_bounded_stream_is_a_summary_with_its_error(spark, seed, cap):
    rng = random.Random(seed)
    key = lambda: rng.choice([None, f"k{int(rng.paretovariate(0.7))}", f"u{rng.randint(0, 60)}"])
    batches = [[key() for _ in range(rng.randint(20, 120))] + ["hot"] * 30 for _ in range(4)]
    counters, error = merged(batches, cap)
    versions = Versions(fresh_dir(spark, "stream"))
    S.start_bounded_profile(in_batches(spark, batches), "user_id", versions, cap=cap).awaitTermination()
    row = versions.latest(spark).first()
    rows = [k for batch in batches for k in batch]
    assert row.count_error == error and 0 < error * (cap + 1) <= len(rows)
    assert (row.total_rows, row.null_count) == (len(rows), rows.count(None))
    held = {r.key: r.n for r in S.keys_of_state(versions.state(spark, 3)).collect()}
    assert held == counters and len(held) <= cap
    for k, n in Counter(k for k in rows if k is not None).items():
        assert held.get(k, 0) <= n <= held.get(k, 0) + error
    assert row.top_keys[0].key == "hot"


def test_load_of_a_stream_is_that_of_the_table(spark, staged):
    columns = [*COLUMNS, ("event_type", "user_id")]
    df, path = staged
    for start in (S.start_profile, S.start_bounded_profile):
        versions = Versions(fresh_dir(spark, "stream"))
        start(S.stream_files(spark, path, df.schema), columns, versions).awaitTermination()
        state = versions.state(spark, versions.last_batch(spark))
        for n in (1, 7, 64):
            got = S.load_of_state(state, n)
            expected = load.hash_bucket_load(df, columns, n)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
        with pytest.raises(ValueError, match="divide"):
            S.load_of_state(state, 11)


def test_replayed_batch_gives_the_same_state(spark, staged):
    versions = finished(spark, staged, S.start_bounded_profile)
    last = versions.last_batch(spark)
    before = sorted(map(str, versions.state(spark, last).collect()))
    # What a restart does when the last batch was not committed.
    import glob
    import os

    local = versions.checkpoint.removeprefix("file:")
    os.remove(f"{local}/commits/{last}")
    for crc in glob.glob(f"{local}/commits/.{last}.crc"):
        os.remove(crc)
    df, path = staged
    S.start_bounded_profile(
        S.stream_files(spark, path, df.schema), COLUMNS, versions
    ).awaitTermination()
    assert versions.last_batch(spark) == last
    assert sorted(map(str, versions.state(spark, last).collect())) == before


def test_old_state_is_removed(spark, staged):
    versions = finished(spark, staged, S.start_profile)
    assert sorted(child_names(spark, f"{versions.root}/state")) == ["batch_id=2", "batch_id=3"]


def test_stream_without_rows(spark, events):
    path = fresh_dir(spark, "nothing")
    events.limit(0).write.parquet(path)
    for start in (S.start_profile, S.start_bounded_profile):
        versions = Versions(fresh_dir(spark, "stream"))
        stream = S.stream_files(spark, path, events.schema)
        start(stream, COLUMNS, versions).awaitTermination()
        row = S.final_summary(spark, versions, {"user_id": "bigint"}).first()
        assert [(c["column"], c.total_rows) for c in row.column_stats] == [(c, 0) for c in COLUMNS]
        assert row.loads[0].load is None


def test_final_summary(spark, staged):
    versions = finished(spark, staged, S.start_profile)
    row = S.final_summary(spark, versions, {"user_id": "bigint"}, workers=4).first()
    assert [c["column"] for c in row.column_stats] == COLUMNS
    assert row.loads[0].load.num_workers == 4 and len(row.hints) == 2
    rows = staged[0].count()
    assert [entry.load.total_rows for entry in row.loads] == [rows, rows]


def test_state_files_do_not_join_tasks(spark, tmp_path):
    """Few files of a state must not make few tasks of the query before."""
    from pyspark import TaskContext

    task = F.udf(lambda _: TaskContext.get().taskAttemptId(), "bigint")
    rows = spark.range(0, 30, 1, 30).select(F.lit("k").alias("column"), task("id").alias("n"))
    versions = Versions(str(tmp_path / "v"))
    state = versions.save_state(state_rows(rows, "load"), 0)
    assert state.select("n").distinct().count() == 30
    versions.save_snapshot(rows, 0)
    assert versions.latest(spark).select("n").distinct().count() == 30
    assert len(list((tmp_path / "v/snapshots/batch_id=0").glob("*.parquet"))) == 1
