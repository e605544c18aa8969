import hashlib
import math

import pytest
from pyspark.sql import functions as F

from keybalance.operators import bounded, cms, frequency
from keybalance.operators.frequency import key_frequency


def freq(df, **kw):
    return frequency.key_frequency(df, df.columns[0], **kw)


def numbered(spark, prefix, n):
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("k"))


def distinct(df, b=14):
    return bounded.fast_distinct(df, df.columns[0], b).first().cardinality_estimate


def test_distinct_sketch_of_few_keys(keyed):
    assert distinct(keyed(["only"])) == 1 and distinct(keyed(["same"] * 1000)) == 1
    assert distinct(keyed([None])) == 0 and distinct(keyed([])) == 0


def test_distinct_sketch_of_many_keys(spark):
    assert abs(distinct(numbered(spark, "u", 60_000)) / 60_000 - 1) < 3 * bounded.standard_error()
    assert bounded.standard_error(14) == pytest.approx(0.008125)
    with pytest.raises(ValueError):
        bounded.standard_error(3)


def test_distinct_sketches_merge(spark):
    a, b = (bounded.bounded_state(numbered(spark, p, 700), "k", 12) for p in ("a", "b"))
    both = bounded.merged_sketches(a, b).select(bounded.sketch_estimate("distinct").alias("e"))
    assert abs(both.first().e - 1400) < 1400 * 3 * bounded.standard_error(12)
    again = bounded.merged_sketches(a, a).select(bounded.sketch_estimate("distinct").alias("e"))
    assert abs(again.first().e - 700) < 700 * 3 * bounded.standard_error(12)


@pytest.mark.parametrize("depth", [5, 11])
def test_cms_cells_by_hand(keyed, depth):
    keys = ["", "a", "a", "héé", "x" * 1000, None, "日本語", "user_1"]
    shape = cms.CmsShape(0.01, math.exp(0.5 - depth))
    assert shape.depth == depth
    expected = {}
    for key in keys:
        for row in range(depth if key is not None else 0):
            text = key if row < 8 else f"{key}#{row // 8}"
            part = hashlib.sha256(text.encode()).hexdigest()[8 * (row % 8) :][:8]
            cell = int(part, 16) % shape.width
            expected[row, cell] = expected.get((row, cell), 0) + 1
    for rows in (cms.cms_cells(freq(keyed(keys)), shape), cms.scan_cells(keyed(keys), "k", shape)):
        assert {(r["row"], r.cell): r.cnt for r in rows.collect()} == expected


def test_scan_cells_with_weights(spark):
    df = spark.createDataFrame([("a", 3), ("a", 4), ("b", 1)], "k string, w int")
    same = lambda x: sorted(map(str, x.collect()))
    assert same(cms.scan_cells(df, "k", weight="w")) == same(cms.cms_cells(freq(df, weight="w")))
    with pytest.raises(Exception, match="at least 1"):
        cms.scan_cells(df.withColumn("w", F.lit(0)), "k", weight="w").collect()


def probe(keyed, cells, shape, *keys):
    probes = keyed(list(keys)).select(F.lit("k").alias("column"), F.col("k").alias("key"))
    return {r.key: r.estimate for r in cms.cms_estimate(cells, probes, shape).collect()}


def test_cms_estimates(spark, keyed):
    shape = cms.CmsShape(0.01, 0.01)
    df = spark.createDataFrame([("user_id_42", 100), ("user_id_42", 10), ("a", 5)], "k string, n int")
    cells = cms.cms_cells(freq(df, weight="n"), shape)
    assert probe(keyed, cells, shape, "user_id_42", "never_seen") == {"user_id_42": 110, "never_seen": 0}
    assert cms.cms_total(cells).first().total_count == 115


def test_cms_integer_key(keyed, spark):
    shape = cms.CmsShape(0.05, 0.05)
    cells = cms.cms_cells(freq(keyed([42] * 5, "int")), shape)
    assert probe(keyed, cells, shape, "42") == {"42": 5}


def test_cms_never_underestimates(spark, keyed):
    shape = cms.CmsShape(0.2, 0.2)  # narrow on purpose: cells are shared
    df = spark.range(2000).select((F.col("id") % 200).cast("string").alias("k"))
    cells = cms.cms_cells(freq(df), shape)
    found = probe(keyed, cells, shape, *[str(i) for i in range(200)])
    assert len(found) == 200 and all(v >= 10 for v in found.values())


def test_cms_merge(keyed):
    shape = cms.CmsShape(0.05, 0.05)
    a = cms.cms_cells(freq(keyed(["shared"] * 3 + ["x"])), shape)
    b = cms.cms_cells(freq(keyed(["shared"] * 7)), shape)
    merged = cms.cms_merge(a, b, shape, shape)
    assert probe(keyed, merged, shape, "shared")["shared"] == 10
    assert cms.cms_total(merged).first().total_count == 11
    whole = cms.cms_cells(freq(keyed(["shared"] * 10 + ["x"])), shape)
    assert sorted(merged.collect()) == sorted(whole.collect())
    with pytest.raises(ValueError):
        cms.cms_merge(a, b, shape, cms.CmsShape(0.01, 0.05))


def test_cms_shape():
    shape = cms.CmsShape()
    assert (shape.width, shape.depth, shape.memory_bytes) == (544, 5, 21760)
    assert shape.width == math.ceil(math.e / 0.005)
    for epsilon, delta in ((0, 0.05), (1, 0.05), (0.05, 0), (0.05, 1)):
        with pytest.raises(ValueError):
            cms.CmsShape(epsilon, delta)


@pytest.mark.parametrize("slots", [1, 3, 1 << 16])
def test_scanned_cells_are_those_of_the_counts(spark, events, slots, monkeypatch):
    """Keys that repeat, keys that do not, nulls, and a table that is often full."""
    df = events.limit(2000).withColumn("k", F.when(F.col("event_id") % 3 > 0, F.col("event_type")))
    columns = ["k", "event_id", ("event_type", "user_id")]
    shape = cms.CmsShape(0.05, 0.0001)  # more rows than one digest has numbers for
    monkeypatch.setattr(cms.KeyTable, "SLOTS", slots)
    order = ["column", "row", "cell", "cnt"]
    found = cms.scan_cells(df, columns, shape).select(*order).collect()
    assert shape.depth > 8
    assert sorted(found) == sorted(cms.cms_cells(key_frequency(df, columns), shape).select(*order).collect())


def test_scanned_weights(spark, events):
    df = events.limit(500).withColumn("w", F.col("event_id") % 5 + 1)
    order = ["column", "row", "cell", "cnt"]
    found = cms.scan_cells(df, ["event_type"], weight="w").select(*order).collect()
    counted = cms.cms_cells(key_frequency(df, ["event_type"], weight="w")).select(*order).collect()
    assert sorted(found) == sorted(counted)
    with pytest.raises(Exception, match="at least 1"):
        cms.scan_cells(df, ["event_type"], weight="event_id").collect()
