import random
from collections import Counter
from itertools import combinations

import pytest

from keybalance.operators import composite

COLUMNS = ["a", "b", "c", "d", "e"]


def table(spark, seed, rows=600):
    rng = random.Random(seed)
    skewed = lambda n: None if rng.random() < 0.05 else min(n, int(rng.paretovariate(0.9)))
    data = [(skewed(3), f"v{skewed(8)}", skewed(40), float(rng.randint(0, 3)), "same") for _ in range(rows)]
    return data, spark.createDataFrame(data, "a int, b string, c bigint, d double, e string")


def tried(data, slots, most):
    """Every set of up to ``most`` columns, best first."""
    out = []
    for size in range(1, most + 1):
        for places in combinations(range(5), size):
            n = max(Counter(tuple(row[i] for i in places) for row in data).values())
            fits = n * slots <= len(data)
            order = (0, size, n, places) if fits else (1, n, size, places)
            out.append((order, [COLUMNS[i] for i in places], n))
    return min(out)[1:]


@pytest.mark.parametrize("slots", [1, 3, 8, 20, 60, 10_000])
def test_best_set_equals_trying_all(spark, slots):
    data, df = table(spark, slots)
    for most in (3,) if slots != 20 else (1, 2, 3):
        row = composite.best_composite(df, COLUMNS, slots, most).first()
        assert (row["columns"], row.hottest_rows) == tried(data, slots, most)
        assert (row.total_rows, row.fits) == (len(data), row.hottest_rows * slots <= len(data))
        assert f"({', '.join(row['columns'])})" in row.advice


def test_sets_without_a_chance_are_not_counted(spark, monkeypatch):
    data, df = table(spark, 4)
    counted = []
    count = composite.hottest_rows
    monkeypatch.setattr(composite, "hottest_rows", lambda df, sets: counted.append(sets) or count(df, sets))
    search = composite.Search(df, COLUMNS, 20, 3)
    search.run()
    every = [s for s in counted for s in s]
    assert [len(s) for s in every] == sorted(len(s) for s in every)
    assert ("a", "e") not in every and ("d", "e") not in every  # too few values between them
    assert search.ranked()[0] == tuple(tried(data, 20, 3)[0])


def test_several_passes_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(composite, "SETS_A_PASS", 2)
    data, df = table(spark, 2, 100)
    assert composite.hottest_rows(df, [(c,) for c in COLUMNS]) == {
        (c,): max(Counter(row[i] for row in data).values()) for i, c in enumerate(COLUMNS)
    }
    empty = composite.best_composite(df.limit(0), "a,b", 4).first()
    assert (empty["columns"], empty.hottest_rows, empty.fits) == (["a"], 0, True)
    with pytest.raises(ValueError):
        composite.best_composite(df, "a", 0)
    with pytest.raises(ValueError):
        composite.best_composite(df, [("a", "b")], 4)
