"""Remedies for skewed keys: salting, salted aggregation and join, repartition."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from keybalance.functions.hashing import row_identity, row_salt
from keybalance.functions.keys import column_ref
from keybalance.operators.heavy import heavy_keys

SALT_BUCKETS = 8
PARTITIONS = 200


def salt_column(
    df: DataFrame,
    column: str,
    buckets: int = SALT_BUCKETS,
    salt: Column | None = None,
    identity: list[str] | None = None,
    by_key: bool = False,
    name: str | None = None,
) -> DataFrame:
    """``df`` with ``<column>_salted`` = key text, underscore, salt; null stays null.

    The salt is taken from the row's identity, so it splits a hot key. ``by_key``
    gives the salt of the key's own hash, which puts all its rows in one bucket.
    """
    if by_key:
        salt = F.pmod(F.hash(column_ref(column)), F.lit(buckets))
    elif salt is None:
        salt = row_salt(df, buckets, identity)
    salted = F.concat(column_ref(column).cast("string"), F.lit("_"), salt.cast("string"))
    return df.withColumn(name or f"{column}_salted", salted)


# For each function: (partial, merge, what the merged value is turned into).
_MERGES = {
    "sum": (F.sum, F.sum, None),
    "min": (F.min, F.min, None),
    "max": (F.max, F.max, None),
    "count": (F.count, F.sum, None),
    "approx_distinct": (F.hll_sketch_agg, F.hll_union_agg, F.hll_sketch_estimate),
    "collect_list": (F.collect_list, F.collect_list, F.flatten),
}
# Functions of a key's distinct values and how often each occurs.
_BY_VALUE = {
    "count_distinct": lambda value, n: F.count(value),
    "median": lambda value, n: F.percentile(value, F.lit(0.5), n),
}


def _shares(spark: SparkSession, parts: int | None) -> int:
    """Into how many parts the rows are thought to be cut: half a shuffle partition each."""
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if parts < 1:
        raise ValueError(f"need at least one part, got {parts}")
    return parts


def hot_pieces(df: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """(__key0.., __pieces): keys with more than 1/parts of the rows, and how many parts they fill.

    Fewer than ``parts`` rows, so it can be broadcast.
    """
    pieces = F.ceil(F.col("n") * parts / F.col("total")).cast("int")
    names = [column_ref(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    return heavy_keys(df, keys, parts).select(*names, pieces.alias("__pieces"))


def _with_pieces(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """``df`` with ``__pieces`` of its key, 1 for the light ones; null equals null."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & column_ref(k).eqNullSafe(F.col(f"__key{i}"))
    return (
        df.join(F.broadcast(hot), same, "left")
        .withColumn("__pieces", F.coalesce("__pieces", F.lit(1)))
        .drop(*[f"__key{i}" for i in range(len(keys))])
    )


def _value_counts(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(__key0.., __value0.., __n, __g): rows per key and value of each column, in one scan.

    Row sets of several columns are told apart by ``__g``, the place of the column.
    """
    ks = [f"__key{i}" for i in range(len(keys))]
    vs = [f"__value{i}" for i in range(len(values))]
    wide = df.select(
        *[column_ref(k).alias(n) for k, n in zip(keys, ks)],
        *[column_ref(v).alias(n) for v, n in zip(values, vs)],
    )
    count = F.count(F.lit(1)).alias("__n")
    if len(vs) == 1:
        return wide.groupBy(*ks, *vs).agg(count).withColumn("__g", F.lit(0))
    sets = wide.groupingSets([[*ks, v] for v in vs], *ks, *vs)
    # Of the set with column i, every bit of the others is set.
    every, last = (1 << len(vs)) - 1, len(vs) - 1
    place = F.grouping_id()
    number = F.coalesce(*[F.when(place == every - (1 << (last - i)), F.lit(i)) for i in range(len(vs))])
    return sets.agg(count, number.alias("__g"))


def _by_value(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """(__key0.., __rows, *wanted): functions of a key's values, which spreads a key over its values."""
    values = list(dict.fromkeys(col for _, col in wanted.values()))
    counted = _value_counts(df, keys, values)
    of = lambda col: F.when(F.col("__g") == values.index(col), F.col(f"__value{values.index(col)}"))
    return counted.groupBy(*[f"__key{i}" for i in range(len(keys))]).agg(
        F.sum(F.when(F.col("__g") == 0, F.col("__n"))).alias("__rows"),
        *[_BY_VALUE[func](of(col), F.col("__n")).alias(out) for out, (func, col) in wanted.items()],
    )


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, tuple[str, str]],
    parts: int | None = None,
    identity: list[str] | None = None,
) -> DataFrame:
    """Group by ``keys``, hot keys in two steps: per piece of the key, then merged.

    ``aggregates`` maps an output name to (function, column): sum, count, min, max, avg,
    approx_distinct, collect_list, count_distinct, median. ``count`` of ``*`` counts rows. A
    key with more than 1/``parts`` of the rows is cut into as many pieces as parts that it fills
    (twice the shuffle partitions by default); light keys have one. A hot null key is
    cut as well.

    The input is scanned three times at most: ``count_distinct`` and ``median`` share one count of
    keys and values, which also tells the hot keys; without them, finding these takes two scans.

    Spark's own partial aggregation already shrinks sums and counts before the shuffle;
    this pays off where the state per group stays large, as for lists. For other
    functions see ``salted_apply``.
    """
    partial, final = [], []
    by_value = {out: wanted for out, wanted in aggregates.items() if wanted[0] in _BY_VALUE}
    for out, (func, col) in aggregates.items():
        value = F.lit(1) if col == "*" else column_ref(col)
        if func == "avg":
            partial += [F.sum(value).alias(f"{out}__s"), F.count(value).alias(f"{out}__c")]
            count = F.sum(f"{out}__c")
            final.append(F.when(count > 0, F.sum(f"{out}__s") / count).alias(out))
        elif func in _MERGES:
            first, merge, turn = _MERGES[func]
            partial.append(first(value).alias(f"{out}__p"))
            merged = merge(f"{out}__p")
            final.append((turn(merged) if turn else merged).alias(out))
        elif func not in _BY_VALUE:
            known = sorted([*_MERGES, *_BY_VALUE, "avg"])
            raise ValueError(f"no aggregate {func!r}; there are {known}")
    refs = [column_ref(k) for k in keys]
    names = [f"__key{i}" for i in range(len(keys))]
    parts = _shares(df.sparkSession, parts)
    values = _by_value(df, keys, by_value) if by_value else None
    if by_value and not partial:
        renamed = [F.col(n).alias(k) for n, k in zip(names, keys)]
        return values.select(*renamed, *aggregates)
    hot = hot_pieces(df, keys, parts) if values is None else _hot_of(values, df, names, parts)
    row = F.xxhash64(*row_identity(df, identity))
    pieces = _with_pieces(df.withColumn("__row", row), keys, hot)
    merged = (
        pieces.groupBy(*refs, F.pmod("__row", "__pieces").alias("__salt"))
        .agg(F.count(F.lit(1)).alias("__rows"), *partial)
        .groupBy(*refs)
        .agg(*final)
    )
    if values is not None:
        same = reduce(lambda a, b: a & b, [r.eqNullSafe(F.col(n)) for r, n in zip(refs, names)])
        merged = merged.join(values.drop("__rows"), same, "left").drop(*names)
    return merged.select(*refs, *aggregates)


def _hot_of(values: DataFrame, df: DataFrame, names: list[str], parts: int) -> DataFrame:
    """As ``hot_pieces``, from rows per key that are counted already; fewer than ``parts`` rows.

    The number of all rows is a scalar subquery that reads no column.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = F.col("__rows") * parts
    pieces = F.ceil(F.col("__rows") * parts / total).cast("int")
    return values.where(rows > total).select(*names, pieces.alias("__pieces"))


def salted_apply(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    partial_schema: T.StructType | str,
    schema: T.StructType | str,
    parts: int | None = None,
    identity: list[str] | None = None,
) -> DataFrame:
    """Group by ``keys`` with functions of your own: ``partial`` per piece of a key, then ``merge``.

    ``partial`` gets rows of one key, at most about 1/``parts`` of the table, and returns what is to
    be merged, with the key columns; ``merge`` gets all that of one key. Both are pandas functions as
    in ``applyInPandas``. A light key has one piece.
    """
    refs = [column_ref(k) for k in keys]
    row = F.xxhash64(*row_identity(df, identity))
    parts = _shares(df.sparkSession, parts)
    cut = _with_pieces(df.withColumn("__row", row), keys, hot_pieces(df, keys, parts))
    salted = cut.withColumn("__salt", F.pmod("__row", "__pieces")).drop("__row", "__pieces")

    def of_piece(rows: pd.DataFrame) -> pd.DataFrame:
        return partial(rows.drop(columns="__salt"))

    by_piece = salted.groupBy(*refs, "__salt").applyInPandas(of_piece, partial_schema)
    return by_piece.groupBy(*refs).applyInPandas(merge, schema)


#: Joins by the name that Spark gives them.
_JOINS = {
    "inner": "inner", "left": "left", "left_outer": "left", "right": "right", "right_outer": "right",
    "outer": "full", "full": "full", "full_outer": "full", "left_semi": "left_semi", "semi": "left_semi",
    "left_anti": "left_anti", "anti": "left_anti",
}


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot_share: int | None = None,
    identity: list[str] | None = None,
) -> DataFrame:
    """Join in which a hot key of ``big`` is spread over as many tasks as it has rows for.

    Hot keys hold more than 1/``hot_share`` of the rows of ``big`` (by default half of
    what a shuffle partition holds), so there are fewer than ``hot_share`` of them, and each is
    cut into as many pieces as it holds such shares. Only their rows in ``small`` are
    copied, once per piece, and every row of ``big`` meets exactly one copy.

    Right and full joins also keep the rows of ``small`` that match nothing. A copied row always
    matches: its key is hot, so ``big`` has it. So copies that met no row are dropped, and what
    was not copied is kept as it is. Rows with a null in their key match nothing and are not copied.
    """
    kind = _JOINS.get(how)
    if kind is None:
        raise ValueError(f"no join {how!r}; there are {sorted(_JOINS)}")
    on = list(on)
    hot = hot_pieces(big, on, _shares(big.sparkSession, hot_share))
    row = F.xxhash64(*row_identity(big, identity))
    # A hot null key matches nothing, but outer joins keep its rows: it is cut as well.
    left = (
        _with_pieces(big.withColumn("__row", row), on, hot)
        .withColumn("__salt", F.pmod("__row", "__pieces").cast("int"))
        .drop("__row", "__pieces")
    )
    no_key = reduce(lambda a, b: a | b, [column_ref(c).isNull() for c in on])
    right = (
        _with_pieces(small, on, hot)
        .withColumn("__copies", F.when(no_key, F.lit(1)).otherwise(F.col("__pieces")))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
        .drop("__pieces")
    )
    if kind not in ("right", "full"):
        return left.join(right.drop("__copies"), [*on, "__salt"], kind).drop("__salt")
    joined = left.withColumn("__met", F.lit(True)).join(right, [*on, "__salt"], kind)
    unmet_copy = F.col("__met").isNull() & (F.col("__copies") > 1)
    return joined.where(~unmet_copy).drop("__salt", "__met", "__copies")


def repartition_by_key(
    df: DataFrame, columns: Sequence[str], n: int = PARTITIONS
) -> DataFrame:
    """Hash layout: all rows of a key in one of n partitions."""
    if n < 1:
        raise ValueError(f"need at least one partition, got {n}")
    return df.repartition(n, *[column_ref(c) for c in columns])


def partition_layout(df: DataFrame) -> DataFrame:
    """(partition, rows) of a DataFrame as it is laid out; empty ones are absent."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(
        F.count(F.lit(1)).alias("rows")
    )
