import json

import pytest
from pyspark.sql import functions as F

from keybalance.operators import advisor
from keybalance.operators.distribution import TOP_KEYS_TYPE, with_shape
from keybalance.operators.profile import PROFILE_COLUMNS
from keybalance.plans import report as R


@pytest.fixture
def stats(spark):
    """Profile rows from (column, counts, skew or None, null_fraction)."""

    def make(*specs):
        rows = [
            (c, [(f"key_{i}", n) for i, n in enumerate(counts)], float(nulls), skew, pos)
            for pos, (c, counts, skew, nulls) in enumerate(specs, start=1)
        ]
        schema = f"column string, top_keys {TOP_KEYS_TYPE}, null_fraction double, s double, position int"
        df = with_shape(spark.createDataFrame(rows, schema))
        return (
            df.withColumn("skew_ratio", F.coalesce("s", "skew_ratio"))
            .withColumn("total_rows", F.lit(1000).cast("bigint"))
            .withColumn("null_count", F.lit(0).cast("bigint"))
            .withColumn("cardinality_estimate", F.lit(1234567.9))
            .withColumn("batch_count", F.lit(1).cast("bigint"))
            .withColumn("hll_error", F.lit(0.0081))
            .withColumn("key_skew_ratio", F.lit(None).cast("double"))
            .withColumn("key_entropy", F.lit(None).cast("double"))
            .select(*PROFILE_COLUMNS)
        )

    return make


def scores(df):
    return {r["column"]: r for r in advisor.score(df).collect()}


def test_good_severe_and_null_columns(stats):
    got = scores(
        stats(
            ("region", [100, 95, 102, 98], 1.1, 0),
            ("user_id", [9000, 100, 50, 30], 45.0, 0),
            ("nullable", [100, 100], 1.0, 0.4),
        )
    )
    assert got["region"].severity == "good" and got["region"].composite_score >= 75
    assert got["user_id"].severity in {"danger", "critical"}
    assert got["user_id"].composite_score < 50
    assert got["nullable"].null_penalty == 40.0


def test_scores_by_hand(stats):
    got = scores(stats(("c", [10, 10], 2.0, 0.25)))["c"]
    assert (got.entropy_score, got.null_penalty, got.skew_penalty) == (100.0, 25.0, 4.0)
    assert got.composite_score == pytest.approx(40 + 0.3 * 75 + 0.3 * 96, abs=0.05)


def test_skew_penalty_is_capped(stats):
    assert scores(stats(("c", [10, 10], 80.0, 0)))["c"].skew_penalty == 100.0


def test_every_severity_and_sentence(stats):
    got = scores(
        stats(
            ("good", [1] * 5, 1.0, 0),
            ("skewed", [1] * 5, 45.0, 0.1),
            ("nulls", [100, 1], 2.0, 0.2),
            ("plain", [100, 1], 2.0, 0.05),
            ("danger", [100, 1], 25.0, 0.5),
            ("critical", [100], 45.0, 0.9),
        )
    )
    assert [got[c].severity for c in ("good", "skewed", "nulls", "plain", "danger", "critical")] == [
        "good", "warning", "warning", "info", "danger", "critical",
    ]
    assert got["skewed"].recommendation == advisor.MODERATE_SKEW
    assert got["nulls"].recommendation == advisor.HIGH_NULLS
    assert got["critical"].recommendation == advisor.SEVERE


def test_ranking_and_ties(stats):
    df = stats(
        ("user_id", [5000, 10, 5], 40.0, 0), ("region", [100] * 3, 1.1, 0), ("twin", [7] * 3, 1.1, 0)
    )
    ranked = advisor.rank(advisor.score(df)).orderBy("rank").collect()
    assert [r["column"] for r in ranked] == ["region", "twin", "user_id"]


def test_skew_bands(spark):
    ratios = [1.0, 1.5, 1.6, 3.0, 8.0, 20.0, 20.1]
    df = spark.createDataFrame([(r,) for r in ratios], "r double").select(advisor.skew_band(F.col("r")))
    assert [row[0] for row in df.collect()] == [
        "Healthy", "Healthy", "Mild Skew", "Mild Skew", "Moderate Skew", "High Skew", "Severe Skew",
    ]


def test_flags(stats):
    row = advisor.flags(stats(("c", [1, 1], 16.0, 0.31))).first()
    assert row.high_null_rate and row.high_null_penalty and row.high_skew_penalty


def test_explanation(stats):
    rows = stats(("hot", [1], 20.04, 0), ("calm", [1], 5.0, 0))
    hot, calm = [r[0] for r in rows.orderBy("position").select(advisor.explanation()).collect()]
    assert hot == (
        "Column 'hot' has a skew ratio of 20.0x (top partition is 20.0x the mean). Estimated "
        "cardinality: 1,234,567. Salting with 8 buckets should reduce hot-key concentration by ~8x."
    )
    assert calm.endswith("Standard repartition should suffice.")


def test_nested_report(events):
    nested = R.report(events, "user_id, event_type", workers=4)
    record = json.loads(R.to_json(nested).first().report)
    assert [c["column"] for c in record["column_stats"]] == ["user_id", "event_type"]
    assert record["scores"][0]["composite_score"] >= record["scores"][1]["composite_score"]
    assert {s["column"]: s["type"] for s in record["schema_info"]}["value"] == "double"
    assert len(record["loads"][0]["workers"]) == 4
    assert sum(w["is_straggler"] for w in record["loads"][0]["workers"]) == 1
    assert record["loads"][0]["load"]["total_rows"] == events.count()
    assert len(R.report(events, "user_id", workers=1500, bounded=True).first().loads[0].workers) == 1500
    with pytest.raises(ValueError):
        R.report(events, "user_id", workers=0)


def test_report_of_all_null_column(keyed):
    row = R.report(keyed([None, None]), "k").first()
    assert row.loads[0].load.total_rows == 2  # nulls load a worker as well
    assert row.scores[0].severity == "danger"
