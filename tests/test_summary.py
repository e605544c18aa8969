import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keybalance.operators import summary


def drawn(seed, n, keys=80):
    rng = random.Random(seed)
    return [rng.choice([None, "hot", f"k{rng.randint(0, keys)}", f"z{int(rng.paretovariate(0.6))}"]) for _ in range(n)]


def counters(row):
    return {x.key: x.n for x in row["keys"]}


def within(row, keys, cap):
    true = Counter(k for k in keys if k is not None)
    held = counters(row)
    assert row["rows"] == sum(true.values())
    assert len(held) <= cap and row["error"] * (cap + 1) <= row["rows"]
    assert all(held.get(k, 0) <= n <= held.get(k, 0) + row["error"] for k, n in true.items())
    assert set(held) <= set(true)


@pytest.mark.parametrize("cap", [1, 7, 60, 1000])
def test_summary_is_within_its_error(keyed, cap):
    keys = drawn(cap, 900)
    row = summary.summarize(keyed(keys), "k", cap).first()
    within(row, keys, cap)
    if cap == 1000:
        assert row["error"] == 0 and counters(row) == Counter(k for k in keys if k is not None)


@pytest.mark.parametrize("cap", [1, 5, 40])
def test_merged_summaries_keep_the_bound(keyed, cap):
    parts = [drawn(100 + i, 300 + 50 * i) for i in range(5)]
    each = [summary.summarize(keyed(p), "k", cap) for p in parts]
    left = summary.merge(each[0].unionByName(each[1]), cap)
    right = summary.merge(each[2].unionByName(each[3]).unionByName(each[4]), cap)
    within(summary.merge(left.unionByName(right), cap).first(), [k for p in parts for k in p], cap)


def test_equal_counts_leave_no_counter(keyed):
    row = summary.summarize(keyed([f"k{i}" for i in range(50)] * 3), "k", 10).first()
    assert (row["rows"], row["error"], row["keys"]) == (150, 3, [])


def test_no_keys(keyed):
    row = summary.summarize(keyed([None, None]), "k", 3).first()
    assert (row["rows"], row["error"], row["keys"]) == (0, 0, [])
    with pytest.raises(ValueError):
        summary.summarize(keyed(["a"]), "k", 0)


def test_what_is_known_of_a_share(spark):
    df = spark.createDataFrame([(60, 5, 100), (48, 5, 100), (40, 5, 100)], "n bigint, error bigint, rows bigint")
    got = df.select(summary.guaranteed(F.col("n"), F.col("error"), F.col("rows"), 0.5).alias("x"))
    assert [r.x for r in got.collect()] == ["heavy", "open", "light"]
