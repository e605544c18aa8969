"""Row counts, key frequencies and heavy hitters of candidate columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from keybalance.functions.keys import (
    Candidate,
    Key,
    candidate_name,
    column_ref,
    key_text,
    parse_candidates,
    resolve_key,
)

TOP_K = 20


def request_order(candidates: list[Candidate]) -> Column:
    """Position of the row's ``column`` in the request."""
    names = F.array(*[F.lit(candidate_name(c)) for c in candidates])
    return F.array_position(names, F.col("column")).cast("int")


def _pick(keys: list[Key], group_id: Column, value) -> Column:
    """Per grouping set, the value of the one key that the set groups by.

    The last key is the default, so that a literal result is never null: a null
    filter inferred for it would move below the aggregation.
    """
    last = len(keys) - 1
    # Grouping id of the set {i}: every bit set but the one of column i.
    every = (1 << len(keys)) - 1
    branches = F
    for i, key in enumerate(keys[:last]):
        branches = branches.when(group_id == every - (1 << (last - i)), value(i, key))
    return branches.otherwise(value(last, keys[last]))


def key_frequency(
    df: DataFrame,
    columns: str | Iterable[Candidate],
    by: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact count per (column, key): the table that all profile operators use.

    All candidates share one scan and one shuffle. They are grouping sets over the
    native values, so key text is made per distinct key instead of per row, and
    partial aggregation leaves at most one row per hot key and map task. Null keys
    are kept as ``key IS NULL``. ``by`` adds a column (a batch id) to the grouping;
    ``weight`` sums a column of weights >= 1 instead of counting rows.
    """
    keys = [resolve_key(df, c) for c in parse_candidates(columns, df.columns)]
    extra = [column_ref(by).alias("__by")] if by else []
    counted = F.count(F.lit(1))
    if weight:
        w = column_ref(weight)
        checked = F.when(w < 1, F.raise_error(F.lit("weights must be at least 1"))).otherwise(w)
        extra.append(checked.alias("__w"))
        counted = F.sum("__w")
    slots = [f"__k{i}" for i in range(len(keys))]
    wide = df.select(*[k.value.alias(s) for k, s in zip(keys, slots)], *extra)
    by_cols = ["__by"] if by else []
    if len(keys) == 1:
        grouped = wide.groupBy(*by_cols, *slots).agg(counted.cast("bigint").alias("n"))
        name, key = F.lit(keys[0].name), keys[0].text(F.col(slots[0]))
    else:
        grouped = wide.groupingSets(
            [[*by_cols, s] for s in slots], *by_cols, *slots
        ).agg(counted.cast("bigint").alias("n"), F.grouping_id().alias("__g"))
        g = F.col("__g")
        name = _pick(keys, g, lambda i, k: F.lit(k.name))
        key = _pick(keys, g, lambda i, k: k.text(F.col(slots[i])))
    out = [name.alias("column"), key.alias("key")]
    if by:
        out.append(F.col("__by").alias(by))
    return grouped.select(*out, "n")


def long_form(df: DataFrame, columns: str | Iterable[Candidate]) -> DataFrame:
    """Rows as (column, key): one row per input row and candidate, nulls kept."""
    candidates = parse_candidates(columns, df.columns)
    names = [candidate_name(c) for c in candidates]
    return df.select(
        *[key_text(df, c).alias(n) for c, n in zip(candidates, names)]
    ).unpivot([], [column_ref(n) for n in names], "column", "key")


def null_counts(df: DataFrame, columns: str | Iterable[Candidate]) -> DataFrame:
    """total_rows, null_count and null_fraction per column: one scan, one row per task."""
    keys = [resolve_key(df, c) for c in parse_candidates(columns, df.columns)]
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(k.value).alias(f"__n{i}") for i, k in enumerate(keys)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(k.name).alias("column"),
                F.col("total").alias("total_rows"),
                (F.col("total") - F.col(f"__n{i}")).alias("null_count"),
            )
            for i, k in enumerate(keys)
        ]
    )
    return counts.select(F.inline(rows)).withColumn("null_fraction", null_fraction())


def null_fraction() -> Column:
    total = F.col("total_rows")
    share = F.col("null_count").cast("double") / total
    return F.when(total > 0, share).otherwise(F.lit(0.0))


def present_keys(freq: DataFrame) -> DataFrame:
    """Rows of non-null keys that occur.

    The condition takes count and key together, so it stays above the aggregation.
    A plain null filter would move below it, and branches with and without the
    filter would each scan and shuffle the table instead of sharing one shuffle.
    """
    return freq.where(F.when(F.col("key").isNull(), F.lit(0)).otherwise(F.col("n")) > 0)


def top_keys(freq: DataFrame, k: int = TOP_K, within: tuple[str, ...] = ("column",)) -> DataFrame:
    """The ``k`` most frequent non-null keys per column, ties by key text.

    The rank filter plans as a partial window group limit: every task forwards at
    most ``k`` rows per column.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    order = Window.partitionBy(*within).orderBy(F.desc("n"), F.asc("key"))
    return (
        present_keys(freq)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def not_null(df: DataFrame, column: str) -> DataFrame:
    """The remedy for a high null rate: only rows that have the key."""
    return df.where(column_ref(column).isNotNull())
