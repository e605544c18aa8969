import datetime
import decimal
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keybalance.functions.keys import key_text, parse_candidates
from keybalance.operators import advisor, bounded, frequency, profile as P
from keybalance.operators.distribution import distribution, whole_distribution


def one(df, column=None):
    rows = {r["column"]: r for r in df.collect()}
    return rows[column] if column else next(iter(rows.values()))


def drawn(seed, n):
    """Keys of uneven frequency, some null."""
    rng = random.Random(seed)
    return [rng.choice([None, f"u{rng.randint(0, 40)}", f"p{int(rng.paretovariate(0.8))}"]) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_profile_against_counting(keyed, seed):
    keys = drawn(seed, 700)
    counts = Counter(k for k in keys if k is not None)
    top = sorted(counts.items(), key=lambda kn: (-kn[1], kn[0]))[:20]
    sizes = [n for _, n in top]
    row = one(P.profile(keyed(keys), "k"))
    assert [tuple(t) for t in row.top_keys] == top and row.partition_counts == sizes
    assert (row.total_rows, row.null_count) == (len(keys), keys.count(None))
    assert row.null_fraction == pytest.approx(keys.count(None) / len(keys))
    assert row.cardinality_estimate == len(counts)
    assert row.skew_ratio == pytest.approx(sizes[0] / (sum(sizes) / len(sizes)))
    share = [n / sum(sizes) for n in sizes]
    assert row.entropy == pytest.approx(-sum(p * math.log(p) for p in share))
    nulls = one(frequency.null_counts(keyed(keys), "k"))
    assert (nulls.total_rows, nulls.null_count) == (len(keys), keys.count(None))


def test_several_columns_in_request_order(spark):
    rows = list(zip(drawn(8, 90), drawn(9, 90)))
    df = spark.createDataFrame(rows, "first string, second string")
    got = P.profile(df, "second, first").orderBy("position").collect()
    assert [(r["column"], r.null_count) for r in got] == [
        (name, [row[i] for row in rows].count(None)) for i, name in ((1, "second"), (0, "first"))
    ]


def test_entropy_of_one_key_is_zero(keyed):
    assert one(P.profile(keyed(["only"] * 37), "k")).entropy == 0.0


def test_column_requests(keyed):
    df = keyed(["a"])
    for empty in ("", " , ", []):
        with pytest.raises(ValueError, match="at least one"):
            P.profile(df, empty)
    with pytest.raises(ValueError, match="available: \\['k'\\]"):
        P.profile(df, "k,missing")
    assert parse_candidates(" k, k ,,k", ["k"]) == ["k"]
    assert parse_candidates([("k",), "k"], ["k"]) == ["k"]
    with pytest.raises(ValueError, match="a\\|b"):
        parse_candidates(["a|b", ("a", "b")], ["a", "b", "a|b"])
    with pytest.raises(KeyError):
        P.column_profile(P.profile(df, "k"), ["k"], "other")


def test_empty_table_keeps_its_columns(keyed):
    row = one(P.profile(keyed([]), "k"))
    assert (row.total_rows, row.null_fraction, row.skew_ratio, row.batch_count) == (0, 0.0, 1.0, 0)
    assert row.cardinality_estimate == 0 and row.top_keys == [] and row.entropy == 0.0


def test_all_null_column_scores_danger(keyed):
    row = one(advisor.score(P.profile(keyed([None] * 5), "k")))
    assert (row.composite_score, row.severity) == (29.4, "danger")


def test_one_value_column_scores_info(keyed):
    row = one(advisor.score(P.profile(keyed(["x"] * 5), "k")))
    assert (row.composite_score, row.severity) == (59.4, "info")


def test_ties_by_key_and_top_k_limit(keyed):
    freq = frequency.key_frequency(keyed([f"k{i:02d}" for i in range(30)]), "k")
    top = frequency.top_keys(freq).orderBy("rank").collect()
    assert [r.key for r in top] == [f"k{i:02d}" for i in range(20)]
    with pytest.raises(ValueError):
        frequency.top_keys(freq, 0)


def test_null_does_not_take_a_top_k_place(keyed):
    freq = frequency.key_frequency(keyed([None] * 9 + ["a", "b", "c"]), "k")
    assert [r.key for r in frequency.top_keys(freq, 2).orderBy("rank").collect()] == ["a", "b"]


def test_batch_count_follows_batch_size(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    assert one(P.profile(df, "k", batch_rows=50)).batch_count == 3


def test_key_text_of_types(spark):
    df = spark.createDataFrame(
        [
            (
                True, 7, 2**40, 1.5, decimal.Decimal("2.50"), "s", datetime.date(2024, 1, 2),
                datetime.datetime(2024, 1, 2, 3, 4, 5), bytearray(b"\xff\x00"), [1, 2],
            )
        ],
        "b boolean, i int, l bigint, d double, m decimal(5,2), s string, t date, "
        "n timestamp_ntz, x binary, a array<int>",
    )
    row = df.select(*[key_text(df, c).alias(c) for c in df.columns]).first()
    assert tuple(row) == (
        "true", "7", "1099511627776", "1.5", "2.50", "s", "2024-01-02", "2024-01-02 03:04:05",
        "FF00", "[1,2]",
    )
    long = {r["column"]: r.key for r in frequency.key_frequency(df, df.columns).collect()}
    assert long == row.asDict()


def test_signed_zero_and_nan_are_keys(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "k double")
    freq = {r.key: r.n for r in frequency.key_frequency(df, "k").collect()}
    assert freq == {"0.0": 1, "-0.0": 1, "NaN": 1, None: 1}
    assert one(P.profile(df, "k")).null_count == 1


def test_map_keys_are_rejected(spark):
    df = spark.sql("SELECT map(1, 2) AS m, struct(map(1, 2) AS x) AS s")
    for column in ("m", "s"):
        with pytest.raises(ValueError, match="map"):
            frequency.key_frequency(df, column)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "`a.b` int, `c``d` int")
    rows = P.profile(df, ["a.b", "c`d"]).orderBy("position").collect()
    assert [r["column"] for r in rows] == ["a.b", "c`d"]
    assert rows[0].partition_counts == [2]


def test_composite_keys_do_not_collide(spark):
    df = spark.createDataFrame(
        [("a|b", "c"), ("a", "b|c"), ("x", None), (None, "x"), (None, None), ("\\N", "x")],
        "p string, q string",
    )
    row = one(P.profile(df, [("p", "q")]))
    assert row["column"] == "p|q"
    assert row.null_count == 1 and row.partition_counts == [1] * 5


def test_weights_must_be_positive(spark):
    df = spark.createDataFrame([("a", 3), ("a", 4)], "k string, w int")
    assert frequency.key_frequency(df, "k", weight="w").first().n == 7
    bad = spark.createDataFrame([("a", 0)], "k string, w int")
    with pytest.raises(Exception, match="at least 1"):
        frequency.key_frequency(bad, "k", weight="w").collect()


def test_long_form_agrees_with_frequency(events):
    columns = ["user_id", "event_type", "value"]
    long = frequency.long_form(events, columns).groupBy("column", "key").count()
    assert long.exceptAll(frequency.key_frequency(events, columns)).count() == 0


def test_profile_scans_the_table_once(events):
    rows = P.profile(events, ["user_id", "event_type"])
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1
    assert "ReusedExchange" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan
    assert "WindowGroupLimit" in plan


BOUNDED = ["column", "total_rows", "null_count", "skew_ratio", "top_keys", "partition_counts"]


def test_bounded_profile_equals_exact(events):
    columns = ["user_id", "event_type", "event_id"]
    exact = P.profile(events, columns).select(*BOUNDED).orderBy("column").collect()
    fixed = P.profile_bounded(events, columns).select(*BOUNDED).orderBy("column").collect()
    assert exact == fixed


def top_of(df):
    return sorted((r["column"], r["rank"], r["key"], r["n"]) for r in df.collect())


@pytest.mark.parametrize(
    "levels, tied, open_buckets", [((1, 4, 64), 3, 2), ((6, 64), 4096, 1 << 17), ((18, 40, 64), 3, 1 << 17)]
)
def test_refined_top_keys_are_exact(keyed, levels, tied, open_buckets, monkeypatch):
    """Skewed keys, flat ones, ties at the floor; few bits, few open buckets, few tied keys looked at."""
    monkeypatch.setattr(bounded, "TIED_KEYS", tied)
    monkeypatch.setattr(bounded, "OPEN_BUCKETS", open_buckets)
    rng = random.Random(len(levels) * tied)
    skewed = [None] * 50 + [f"k{int(rng.paretovariate(0.6))}" for _ in range(1500)] + [f"u{i}" for i in range(500)]
    flat = [f"f{i % 300}" for i in range(900)]
    for keys in (skewed + flat, flat, ["a", "b", "b", None]):
        df = keyed(keys)
        exact = frequency.top_keys(frequency.key_frequency(df, "k"), 15)
        assert top_of(bounded.bucketed_top_keys(df, "k", 15, levels, direct_bytes=0)) == top_of(exact)


def test_equal_counts_move_few_keys(spark, monkeypatch):
    """Of many keys with one count only those below a bound are counted by text."""
    monkeypatch.setattr(bounded, "TIED_KEYS", 1000)
    df = spark.range(40_000).select((F.col("id") % 20_000).cast("string").alias("k"))
    counted = []
    whole = bounded.top_keys
    monkeypatch.setattr(bounded, "top_keys", lambda freq, k: counted.append(freq.count()) or whole(freq, k))
    top = bounded.bucketed_top_keys(df, "k", 10, direct_bytes=0).orderBy("rank").collect()
    assert [(r.key, r.n) for r in top] == [(k, 2) for k in sorted(str(i) for i in range(20_000))[:10]]
    assert counted[0] < 3000


def test_small_input_is_counted_at_once(events):
    assert bounded.input_bytes(events) < bounded.DIRECT_BYTES
    plan = bounded.bucketed_top_keys(events, "user_id")._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" not in plan


def test_bounded_top_keys_with_a_heavy_key(spark):
    # A third of all rows on one key, the rest on one row each.
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k")
    )
    top = bounded.bucketed_top_keys(df, "k", k=1, direct_bytes=0).first()
    assert (top.key, top.n) == ("-1", 30_000)
    row, exact = P.profile_bounded(df, "k").first(), P.profile(df, "k").first()
    assert row.partition_counts == exact.partition_counts == [30_000] + [1] * 19
    assert row.entropy == pytest.approx(exact.entropy)
    assert abs(row.cardinality_estimate - 60_001) < 3 * row.hll_error * 60_001
    assert exact.key_skew_ratio == pytest.approx(30_000 / (90_000 / 60_001))


def test_whole_column_shape(keyed):
    keys = [f"k{i}" for i in range(40)] * 2 + ["hot"] * 20 + [None]
    row = whole_distribution(frequency.key_frequency(keyed(keys), "k")).first()
    assert (row.key_count, row.key_rows, row.max_key) == (41, 100, 20)
    assert row.key_skew_ratio == pytest.approx(20 * 41 / 100)
    assert row.key_entropy == pytest.approx(-40 * 0.02 * math.log(0.02) - 0.2 * math.log(0.2))
    for few, entropy in ((["x"] * 3, 0.0), ([None], 0.0), ([], 0.0)):
        row = one(P.profile(keyed(few), "k"))
        assert (row.key_skew_ratio, row.key_entropy) == (1.0, entropy)


def test_instants_with_one_text_are_two_keys(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.range(2).select(F.timestamp_seconds(1_698_539_400 + F.col("id") * 3600).alias("k"))
        assert [r.n for r in frequency.key_frequency(df, "k").collect()] == [1, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bounded_profile_of_empty_and_null_columns(keyed):
    for keys in ([], [None, None]):
        row = one(P.profile_bounded(keyed(keys), "k"))
        assert (row.total_rows, row.null_count) == (len(keys), len(keys))
        assert row.skew_ratio == 1.0 and row.cardinality_estimate == 0 and row.top_keys == []


def test_distribution_helper(keyed):
    top = frequency.top_keys(frequency.key_frequency(keyed(["a"] * 3 + ["b"]), "k"))
    row = distribution(top).first()
    assert (row.top_rows, row.max_count, row.mean_count, row.top_key_count) == (4, 3, 2.0, 2)
