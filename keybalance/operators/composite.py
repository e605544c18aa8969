"""Which columns make a good key together: a level-wise search over column sets.

A set fits ``slots`` partitions if its hottest key, null included, holds at most 1/slots of the rows. The
best set has the fewest columns that fit, then the fewest rows on its hottest key, then
comes first in the request. If none fits, it is the one with the fewest rows on its hottest key.

Sets are counted in passes over the table, a level of sizes at a time, and only where bounds leave a
doubt. With more columns the hottest key can only shrink, and by no more than the number of
values that the new columns have: hottest(A + B) >= hottest(A) / distinct(B). Distinct values come
from sketches, taken once for all columns, with three standard errors of room.

A set is counted through hash buckets (see ``operators.bounded``), so keys themselves do not move.
The driver holds a number per set.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import prod

from pyspark.sql import DataFrame, functions as F

from keybalance.functions.keys import parse_candidates, resolve_key
from keybalance.operators.bounded import LEVELS, fast_distinct, key_hash_counts, standard_error

MOST_COLUMNS = 3
#: Sets that one pass over the table counts.
SETS_A_PASS = 64

Names = tuple[str, ...]


def hottest_rows(
    df: DataFrame, sets: Sequence[Names], levels: tuple[int, ...] = LEVELS
) -> dict[Names, int]:
    """Rows of the most frequent key of each set of columns; null is a value like others."""
    values = {c: resolve_key(df, c).value for c in dict.fromkeys(c for s in sets for c in s)}
    found = {s: 0 for s in sets}
    for start in range(0, len(sets), SETS_A_PASS):
        some = sets[start : start + SETS_A_PASS]
        rows = [
            F.struct(F.lit(str(i)).alias("column"), F.xxhash64(*[values[c] for c in s]).alias("h"))
            for i, s in enumerate(some)
        ]
        counts = key_hash_counts(df.select(F.inline(F.array(*rows))), 1, levels)
        for row in counts.groupBy("column").agg(F.max("n").alias("n")).collect():
            found[some[int(row["column"])]] = row["n"]
    return found


class Search:
    """Sets counted so far, and what they say of the others."""

    def __init__(self, df: DataFrame, columns: Sequence[str], slots: int, most: int):
        if slots < 1 or most < 1:
            raise ValueError(f"slots and most must be at least 1, got {slots} and {most}")
        self.columns = parse_candidates(columns, df.columns)
        if not all(isinstance(c, str) for c in self.columns):
            raise ValueError("name single columns to combine")
        self.df, self.slots, self.most = df, slots, min(most, len(self.columns))
        self.total = df.count()
        room = 1 + 3 * standard_error()
        estimates = fast_distinct(df, self.columns).collect()
        # One more for null, and one for rounding.
        self.distinct = {r["column"]: r["cardinality_estimate"] * room + 2 for r in estimates}
        self.hottest: dict[Names, int] = {}

    def fits(self, names: Names) -> bool:
        return self.hottest[names] * self.slots <= self.total

    def least(self, names: Names) -> float:
        """What the hottest key of a set holds at least, by its subsets that are counted."""
        known = [s for n in range(1, len(names)) for s in combinations(names, n) if s in self.hottest]
        rest = lambda s: prod(self.distinct[c] for c in names if c not in s)
        return max([self.hottest[s] / rest(s) for s in known], default=0)

    def count(self, sets: Sequence[Names]) -> None:
        self.hottest |= hottest_rows(self.df, [s for s in sets if s not in self.hottest])

    def run(self) -> None:
        for size in range(1, self.most + 1):
            sets = list(combinations(self.columns, size))
            self.count([s for s in sets if self.least(s) * self.slots <= self.total])
            if any(self.fits(s) for s in sets if s in self.hottest):
                return
        # None fits: the largest sets have the smallest hottest keys.
        best = min((n for s, n in self.hottest.items() if len(s) == self.most), default=self.total)
        self.count([s for s in sets if self.least(s) <= best])

    def ranked(self) -> list[Names]:
        places = {c: i for i, c in enumerate(self.columns)}
        in_request = lambda s: [places[c] for c in s]
        fitting = sorted(
            (s for s in self.hottest if self.fits(s)), key=lambda s: (len(s), self.hottest[s], in_request(s))
        )
        others = sorted(
            (s for s in self.hottest if not self.fits(s)), key=lambda s: (self.hottest[s], len(s), in_request(s))
        )
        return fitting + others


def composite_keys(
    df: DataFrame, columns: Sequence[str] | str, slots: int, most: int = MOST_COLUMNS
) -> DataFrame:
    """(rank, columns, hottest_rows, total_rows, fits, advice) of the sets that were counted, best first."""
    search = Search(df, columns, slots, most)
    search.run()
    rows = []
    for rank, names in enumerate(search.ranked(), 1):
        n, fits = search.hottest[names], search.fits(names)
        share = 100 * n / search.total if search.total else 0.0
        kind = "composite key" if len(names) > 1 else "key"
        verdict = f"fits {slots} partitions" if fits else f"is too hot for {slots} partitions"
        advice = f"{kind} ({', '.join(names)}) {verdict}: its hottest value holds {share:.2f} % of the rows"
        rows.append((rank, list(names), n, search.total, fits, advice))
    schema = "rank int, columns array<string>, hottest_rows bigint, total_rows bigint, fits boolean, advice string"
    return df.sparkSession.createDataFrame(rows, schema)


def best_composite(
    df: DataFrame, columns: Sequence[str] | str, slots: int, most: int = MOST_COLUMNS
) -> DataFrame:
    """The first row of ``composite_keys``."""
    return composite_keys(df, columns, slots, most).where(F.col("rank") == 1)
