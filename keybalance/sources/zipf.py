"""Skewed keys drawn per row of an existing table."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from keybalance.functions.keys import column_ref

#: Numbers drawn for one row at most.
ATTEMPTS = 12
_UNIT = float(1 << 52)


def uniform(identity: Sequence[str], seed: str | Column) -> Column:
    """A number in [0, 1) per row, from the SHA-256 of its identity and a seed."""
    text = F.concat_ws(":", F.lit(seed) if isinstance(seed, str) else seed, *[column_ref(c).cast("string") for c in identity])
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(_UNIT)


@dataclass(frozen=True)
class Zipf:
    """Rejection-inversion for weights 1 / rank^exponent over ranks 1..n, after Hoermann and Derflinger.

    A rank comes from inverting the integral of the weights at a uniform number, and is taken
    unless the number falls where integral and sum differ. So it takes no table of ranks.
    """

    n: int
    exponent: float

    def __post_init__(self):
        if self.n < 1 or self.exponent <= 0:
            raise ValueError(f"need n >= 1 and exponent > 0, got {self.n} and {self.exponent}")

    def _integral(self, x: float) -> float:
        e = 1 - self.exponent
        return math.log(x) if e == 0 else (x**e - 1) / e

    def _inverse(self, y: float) -> float:
        e = 1 - self.exponent
        return math.exp(y) if e == 0 else (1 + y * e) ** (1 / e)

    @property
    def first(self) -> float:
        return self._integral(1.5) - 1

    @property
    def last(self) -> float:
        return self._integral(self.n + 0.5)

    @property
    def sure(self) -> float:
        """Ranks this little above the inverted point need no look at the weights."""
        return 2 - self._inverse(self._integral(2.5) - 2**-self.exponent)

    def draw(self, u: Column) -> Column:
        """The rank that a uniform number of [0, 1) gives, null if it is rejected."""
        e = 1 - self.exponent
        log = e == 0
        integral = lambda x: F.log(x) if log else (F.pow(x, F.lit(e)) - 1) / e
        inverse = lambda y: F.exp(y) if log else F.pow(1 + y * e, F.lit(1 / e))

        def taken(row: Column) -> Column:
            rank, y, x = row["rank"], row["y"], row["x"]
            weight = F.pow(rank.cast("double"), F.lit(-self.exponent))
            accepted = (rank - x <= self.sure) | (y >= integral(rank + 0.5) - weight)
            return F.when(accepted, rank)

        def ranked(row: Column) -> Column:
            whole = F.floor(row["x"] + 0.5).cast("bigint")
            rank = F.greatest(F.least(whole, F.lit(self.n)), F.lit(1))
            return _once(F.struct(row["y"].alias("y"), row["x"].alias("x"), rank.alias("rank")), taken)

        y = F.lit(self.last) + u * F.lit(self.first - self.last)
        return _once(y, lambda y: _once(F.struct(y.alias("y"), inverse(y).alias("x")), ranked))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is referred to."""
    return F.transform(F.array(value), use)[0]


def zipf_keys(
    df: DataFrame,
    identity: Sequence[str],
    n: int,
    exponent: float = 1.5,
    seed: str = "42",
    name: str = "rank",
) -> DataFrame:
    """``df`` with a Zipf-distributed rank 1..n per row: an expression over the row's identity.

    Numbers are drawn until one is taken, ``ATTEMPTS`` at most; nine in ten are. Rank 1 stands
    for the rest, less than one row in 10^10.
    """
    zipf = Zipf(n, exponent)

    def attempt(rank: Column, i: Column) -> Column:
        u = uniform(identity, F.concat(F.lit(f"{seed}/"), i.cast("string")))
        return F.coalesce(rank, zipf.draw(u))

    attempts = F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))
    rank = F.aggregate(attempts, F.lit(None).cast("bigint"), attempt)
    return df.withColumn(name, F.coalesce(rank, F.lit(1).cast("bigint")))


def weighted_choice(u: Column, choices: Sequence[tuple[str, float]]) -> Column:
    """The label whose share of [0, 1) holds ``u``; weights are normalised."""
    total = sum(w for _, w in choices)
    upto, picked = 0.0, None
    for label, weight in choices[:-1]:
        upto += weight / total
        condition = u < F.lit(upto)
        picked = F.when(condition, label) if picked is None else picked.when(condition, label)
    last = F.lit(choices[-1][0])
    return last if picked is None else picked.otherwise(last)


# The labels and weights of the skewed sample table.
REGIONS = [
    ("us-east-1", 0.35),
    ("us-west-2", 0.25),
    ("eu-west-1", 0.20),
    ("ap-southeast-1", 0.10),
    ("ap-northeast-1", 0.07),
    ("sa-east-1", 0.03),
]
EVENT_TYPES = [
    ("purchase", 0.15),
    ("view", 0.40),
    ("add_to_cart", 0.20),
    ("search", 0.15),
    ("wishlist", 0.07),
    ("review", 0.03),
]


def skewed_table(
    rows: DataFrame,
    identity: Sequence[str],
    users: int = 10_000,
    products: int = 5_000,
    sessions: int = 49_999,
    null_share: float = 0.05,
    seed: str = "42",
) -> DataFrame:
    """One skewed e-commerce row per row of ``rows``, repeatable for its identity.

    user_id (Zipf 1.5, some nulls), product_id (Zipf 1.1), region and event_type
    (weighted), session_id (uniform) and timestamp (epoch seconds).
    """

    def u(purpose: str) -> Column:
        return uniform(identity, f"{seed}/{purpose}")

    ids = [column_ref(c) for c in identity]
    ranked = zipf_keys(rows.select(*ids), identity, users, 1.5, f"{seed}/user", "__user")
    ranked = zipf_keys(ranked, identity, products, 1.1, f"{seed}/product", "__product")
    user = F.concat(F.lit("user_"), (F.col("__user") - 1).cast("string"))
    return ranked.select(
        *ids,
        F.when(u("null") >= null_share, user).alias("user_id"),
        F.concat(F.lit("prod_"), (F.col("__product") - 1).cast("string")).alias("product_id"),
        weighted_choice(u("region"), REGIONS).alias("region"),
        weighted_choice(u("event_type"), EVENT_TYPES).alias("event_type"),
        F.concat(F.lit("sess_"), (F.floor(u("session") * sessions) + 1).cast("string")).alias(
            "session_id"
        ),
        (F.lit(1_700_000_000) + F.floor(u("timestamp") * 20_000_000)).cast("bigint").alias(
            "timestamp"
        ),
    )
