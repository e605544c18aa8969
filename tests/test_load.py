import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keybalance.operators import heavy, load
from keybalance.operators.remedy import partition_layout


def counted(spark, counts):
    """Table with one key per count."""
    rows = spark.createDataFrame([(f"k{i:03d}", n) for i, n in enumerate(counts)], "k string, n int")
    return rows.select("k", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("x"))


def slots(spark, counts):
    """Rows per slot; slots without rows are absent, as a count gives them."""
    rows = [("c", i, n) for i, n in enumerate(counts) if n]
    return spark.createDataFrame(rows, "column string, slot int, rows bigint")


@pytest.mark.parametrize("n", [1, 2, 7, 40, 500])
def test_report_and_workers_against_counting(spark, n):
    rng = random.Random(n)
    counts = [rng.choice([0, rng.randint(1, 10**6)]) for _ in range(n - 1)] + [rng.randint(1, 10**6)]
    mean, most = sum(counts) / n, max(counts)
    row = load.load_report(slots(spark, counts), n).first()
    assert (row.num_workers, row.total_rows, row.max_rows) == (n, sum(counts), most)
    assert row.mean_rows == pytest.approx(mean)
    assert row.slowdown_factor == pytest.approx(most / mean)
    assert row.idle_fraction == pytest.approx(1 - mean / most)
    assert row.straggler_worker_id == counts.index(most)
    workers = load.worker_load(slots(spark, counts), n).orderBy("worker_id").collect()
    assert [w.assigned_rows for w in workers] == counts
    assert [w.idle_rows for w in workers] == [most - c for c in counts]
    assert [w.worker_id for w in workers if w.is_straggler] == [counts.index(most)]


def test_columns_are_reported_apart(spark):
    rows = [("a", 2, 5), ("a", 0, 5), ("b", 1, 9)]
    loads = spark.createDataFrame(rows, "column string, slot int, rows bigint")
    got = {r["column"]: r.loads for r in load.load_arrays(loads, 4).collect()}
    assert got == {"a": [5, 0, 5, 0], "b": [0, 9, 0, 0]}
    assert {r["column"]: r.straggler_worker_id for r in load.load_report(loads, 4).collect()} == {"a": 0, "b": 1}


def test_arguments(spark):
    for n in (0, -1):
        with pytest.raises(ValueError):
            load.load_report(slots(spark, [3]), n)
        with pytest.raises(ValueError):
            load.hash_bucket_load(spark.range(3), "id", n)


def test_no_rows_no_report(spark):
    assert load.load_report(slots(spark, []), 2).count() == 0


def test_hash_load_is_the_physical_layout(events):
    df = events.withColumn("user_id", F.when(F.col("event_id") % 7 > 0, F.col("user_id")))
    predicted = load.hash_bucket_load(df, ["user_id", ("user_id", "event_type")], 16)
    for column, keys in (("user_id", ["user_id"]), ("user_id|event_type", ["user_id", "event_type"])):
        expected = {r.slot: r.rows for r in predicted.where(F.col("column") == column).collect()}
        # Adaptive execution would join small partitions; a fixed number is kept.
        actual = {r.partition: r.rows for r in partition_layout(df.repartition(16, *keys)).collect()}
        assert actual == expected


def brute_heavy(values, parts):
    return {k: n for k, n in Counter(values).items() if n * parts > len(values)}


@pytest.mark.parametrize("parts", [1, 3, 10, 500, 20_000])
def test_heavy_keys_against_counting(spark, parts):
    rng = random.Random(parts)
    values = [None] * 700 + [0] * 1500 + [int(rng.paretovariate(0.7)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "k bigint")
    rows = heavy.heavy_keys(df, ["k"], parts).collect()
    assert {r.k: r.n for r in rows} == brute_heavy(values, parts)
    assert {r.total for r in rows} <= {len(values)}


def layout(df):
    return sorted(r.rows for r in partition_layout(df).collect())


def skewed(events):
    return events.withColumn(
        "k", F.expr("least(user_id, pmod(event_id * 7919, 150), pmod(event_id * 104729, 150))")
    )


def test_balanced_layout_beats_hashing(events):
    df = skewed(events)
    hashed, balanced = layout(df.repartition(8, "k")), layout(load.balanced_repartition(df, ["k"], 8))
    mean = df.count() / 8
    assert max(hashed) / mean > 1.3
    assert max(balanced) / mean < 1.06 and sum(balanced) == df.count()


def test_whole_keys_stay_in_one_partition(events):
    df = skewed(events)
    laid = load.balanced_repartition(df, ["k"], 8, split_oversized=False)
    spread = laid.withColumn("part", F.spark_partition_id()).groupBy("k").agg(
        F.count_distinct("part").alias("p")
    )
    assert spread.where("p > 1").count() == 0
    assert laid.exceptAll(df).count() == 0 and laid.count() == df.count()


def test_key_with_a_third_of_all_rows_is_split(spark, tmp_path):
    # Exact copies of one row: only the position in the file tells them apart.
    spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 1000).alias("k")
    ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    whole = layout(load.balanced_repartition(df, ["k"], 16, split_oversized=False))
    cut = layout(load.balanced_repartition(df, ["k"], 16))
    assert max(whole) >= 10_000
    assert max(cut) < 1.15 * 30_000 / 16 and sum(cut) == 30_000


def test_packing_of_heavy_keys_is_longest_first(spark):
    rng = random.Random(5)
    counts = [rng.randint(300, 900) for _ in range(30)]
    df = counted(spark, counts)
    n, parts = 4, load._heavy_parts(4)
    rows = {r.k: r.slots for r in load.slot_map(df, ["k"], n, split_oversized=False).collect()}
    by_hash = {r.k: r.s for r in df.select("k", heavy.hash_bucket(["k"], n).alias("s")).distinct().collect()}
    sizes = {f"k{i:03d}": c for i, c in enumerate(counts)}
    big = {k: c for k, c in sizes.items() if c * parts > sum(counts)}
    assert set(rows) == set(big)
    loads = [0] * n
    for k, c in sizes.items():
        loads[by_hash[k]] += c if k not in big else 0
    for k, c in sorted(big.items(), key=lambda kc: (-kc[1], kc[0])):
        slot = loads.index(min(loads))
        assert rows[k] == [slot]
        loads[slot] += c


def test_thousands_of_slots(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    row = load.slot_map(df, ["k"], 5000).collect()
    assert [r.k for r in row] == [-1]
    assert len(set(row[0].slots)) > 1000
    loads = load.hash_bucket_load(df, ["k"], 5000)
    assert load.load_report(loads, 5000).first().total_rows == 200_000


def test_light_keys_keep_their_hash_slot(events):
    df = events.select("event_id", "user_id")
    assigned = load.assign_slots(df, ["event_id"], 4)
    expected = df.withColumn("slot", heavy.hash_bucket(["event_id"], 4))
    assert assigned.exceptAll(expected).count() == 0


def test_loads_count_every_row(events):
    df = events.withColumn("user_id", F.when(F.col("event_id") % 7 > 0, F.col("user_id")))
    row = load.load_report(load.hash_bucket_load(df, "user_id", 8), 8).first()
    assert row.total_rows == df.count()


def test_load_report_scans_once(events):
    rows = load.load_report(load.hash_bucket_load(events, "user_id", 8), 8)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1
