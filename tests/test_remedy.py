import pandas as pd
import pytest
from pyspark.sql import functions as F

from keybalance.operators import remedy


@pytest.fixture(scope="module")
def hot(events):
    key = F.when(F.col("event_id") % 5 < 2, F.lit(0)).otherwise(F.col("user_id"))
    null = F.col("event_id") % 3 == 0
    return events.withColumn("k", F.when(null, None).otherwise(key))


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_salt_splits_a_hot_key(hot):
    salted = remedy.salt_column(hot, "k", 8)
    whole = hot.where("k = 0").count()
    groups = salted.where("k = 0").groupBy("k_salted").count()
    assert groups.count() == 8
    assert groups.agg(F.max("count")).first()[0] < 1.3 * whole / 8
    assert salted.where("k_salted IS NULL").count() == hot.where("k IS NULL").count()


def test_salt_by_key_does_not(hot):
    salted = remedy.salt_column(hot, "k", 8, by_key=True)
    assert salted.where("k = 0").select("k_salted").distinct().count() == 1
    suffix = F.element_at(F.split("k_salted", "_"), -1).cast("int")
    low, high = salted.select(F.min(suffix), F.max(suffix)).first()
    assert low >= 0 and high <= 7


def test_salt_is_repeatable(hot):
    a, b = (remedy.salt_column(hot, "k", 8).select("event_id", "k_salted") for _ in range(2))
    same(a, b)


def test_salt_names_and_arguments(hot):
    named = remedy.salt_column(hot, "k", 3, identity=["event_id"], name="s")
    assert "s" in named.columns
    with pytest.raises(ValueError):
        remedy.salt_column(hot, "k", 0)


AGGREGATES = {
    "n": ("count", "*"),
    "values": ("count", "value"),
    "total": ("sum", "event_id"),
    "low": ("min", "value"),
    "high": ("max", "value"),
    "mean": ("avg", "event_id"),
}


def test_salted_aggregate_equals_group_by(hot):
    plain = hot.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("values"),
        F.sum("event_id").alias("total"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("event_id").alias("mean"),
    )
    for parts in (None, 20):
        same(remedy.salted_aggregate(hot, ["k"], AGGREGATES, parts=parts), plain)
    distinct = remedy.salted_aggregate(hot, ["k"], {"d": ("approx_distinct", "event_type")})
    same(distinct, hot.groupBy("k").agg(F.count_distinct("event_type").alias("d")))
    with pytest.raises(ValueError):
        remedy.salted_aggregate(hot, ["k"], {"x": ("mode", "value")})


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, hot, how):
    big = hot.select("event_id", "k")
    # Several rows per key, a key that is absent, and a null key.
    small = spark.createDataFrame(
        [(i % 100, f"v{i}") for i in range(150)] + [(None, "null"), (None, "null"), (-5, "absent"), (-5, "absent")],
        "k bigint, v string",
    )
    # The null key and the zero key of the big side are hot, and so is what they are cut into.
    assert {r["__key0"] for r in remedy.hot_pieces(big, ["k"], 20).collect()} == {None, 0}
    same(remedy.salted_join(big, small, ["k"], how, hot_share=20), big.join(small, ["k"], how))


def test_salted_join_spreads_the_hot_key(spark, hot):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        small = hot.select("k").distinct().withColumn("v", F.lit(1))
        joined = remedy.salted_join(hot.select("event_id", "k"), small, ["k"], "left", hot_share=20)
        tasks = joined.where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_salted_join_on_two_columns(hot):
    big = hot.select("event_id", "k", "event_type")
    small = hot.groupBy("k", "event_type").agg(F.max("value").alias("m"))
    on = ["k", "event_type"]
    same(remedy.salted_join(big, small, on, "left", hot_share=30), big.join(small, on, "left"))


@pytest.mark.parametrize("how", ["right_outer", "full_outer"])
def test_outer_joins_on_two_columns(hot, how):
    big = hot.select("event_id", "k", "event_type")
    small = hot.groupBy("k", "event_type").agg(F.max("value").alias("m"))
    more = small.withColumn("k", F.col("k") + 10_000).unionByName(small).unionByName(small.limit(0))
    on = ["k", "event_type"]
    same(remedy.salted_join(big, more, on, how, hot_share=30), big.join(more, on, how))


def test_outer_joins_without_rows_on_one_side(hot):
    big, none = hot.select("event_id", "k"), hot.select("k", "value").limit(0)
    for how in ("right", "full"):
        same(remedy.salted_join(big, none, ["k"], how), big.join(none, ["k"], how))
        same(remedy.salted_join(none, big, ["k"], how), none.join(big, ["k"], how))


def test_salted_join_rejects_other_joins(hot):
    with pytest.raises(ValueError):
        remedy.salted_join(hot, hot, ["k"], "cross")


def scans(df):
    """Scans of the input in the plan that ran; reused exchanges count once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan.count("FileScan parquet")


def test_salted_aggregate_scans_three_times_at_most(hot):
    lists = {"types": ("collect_list", "event_type"), "n": ("count", "*")}
    exact = {"d": ("count_distinct", "event_type"), "m": ("median", "value"), "d2": ("count_distinct", "value")}
    for wanted in (lists, exact, lists | exact):
        assert scans(remedy.salted_aggregate(hot, ["k"], wanted, parts=20)) <= 3


def test_salted_apply_of_own_functions(hot):
    """The three largest values and the number of rows of a key, merged from pieces."""
    rows = hot.select(F.coalesce(F.col("k").cast("string"), F.lit("none")).alias("k"), "value", "event_id")

    def partial(piece):
        best = sorted(piece["value"], reverse=True)[:3]
        return pd.DataFrame({"k": [piece["k"].iloc[0]], "n": [len(piece)], "best": [best]})

    def merge(parts):
        best = sorted((v for one in parts["best"] for v in one), reverse=True)[:3]
        return pd.DataFrame(
            {"k": [parts["k"].iloc[0]], "n": [parts["n"].sum()], "best": [best], "pieces": [len(parts)]}
        )

    schema = "k string, n bigint, best array<double>"
    got = remedy.salted_apply(rows, ["k"], partial, merge, schema, f"{schema}, pieces int", 20, ["event_id"])
    plain = rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.slice(F.reverse(F.array_sort(F.collect_list("value"))), 1, 3).alias("best")
    )
    same(got.drop("pieces"), plain)
    pieces = {r.k: r.pieces for r in got.collect()}
    assert pieces["0"] > 1 and pieces["none"] > 1
    assert min(pieces.values()) == 1


def test_repartition_by_key(events):
    laid = remedy.repartition_by_key(events, ["user_id"], 16)
    assert laid.rdd.getNumPartitions() == 16
    spread = laid.withColumn("part", F.spark_partition_id()).groupBy("user_id").agg(
        F.count_distinct("part").alias("p")
    )
    assert spread.where("p > 1").count() == 0
    with pytest.raises(ValueError):
        remedy.repartition_by_key(events, ["user_id"], 0)


def test_salted_lists_and_exact_functions(hot):
    wanted = {
        "types": ("collect_list", "event_type"),
        "d": ("count_distinct", "value"),
        "m": ("median", "value"),
    }
    plain = hot.groupBy("k").agg(
        F.array_sort(F.collect_list("event_type")).alias("types"),
        F.count_distinct("value").alias("d"),
        F.median("value").alias("m"),
    )
    salted = remedy.salted_aggregate(hot, ["k"], wanted, parts=30)
    same(salted.withColumn("types", F.array_sort("types")), plain)


def test_hot_keys_are_cut_by_their_share(spark, tmp_path):
    """Half of the rows on one key, copies of one row: 200 tasks get about as much each."""
    spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k")
    ).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    hot_rows = remedy.hot_pieces(df, ["k"], 400).collect()
    assert [(r["__key0"], r["__pieces"]) for r in hot_rows] == [(-1, 200)]
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "200",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        small = df.select("k").distinct().withColumn("v", F.lit(1))
        joined = remedy.salted_join(df, small, ["k"], "left")
        rows = [r.rows for r in remedy.partition_layout(joined).collect()]
        assert sum(rows) == 60_000 and max(rows) < 5 * 60_000 / 200
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_rows_without_a_position(spark):
    df = spark.createDataFrame([(1, {"a": 1}, "x")] * 4, "k int, m map<string,int>, s string")
    with pytest.warns(UserWarning, match="file position"):
        assert remedy.salt_column(df, "k", 3).select("k_salted").distinct().count() == 1
    named = remedy.salt_column(df.withColumn("id", F.monotonically_increasing_id()), "k", 3, identity=["id"])
    assert named.count() == 4
