"""Column expressions that the native operators share. No Python runs in tasks here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from keybalance.functions.keys import column_ref

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where the optimizer moves the expression.

    Referring to a computed array inside a lambda could otherwise compute it again
    for each element.
    """
    return F.transform(F.array(value), use)[0]


def once(value: Column) -> Column:
    """Select-list form of a struct column as separate columns, computed once a row.

    It becomes a generator, through which later filters are not pushed, so the
    struct is not computed a second time for them.
    """
    return F.inline(F.array(value))


def text_of(column: str | Column) -> Column:
    return F.coalesce(column_ref(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not blanks; none for an empty text."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def blocks(array: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the slices that an array, computed before, is cut into, about as many as each is long.

    Folding over an array copies what it has gathered at every step. Over slices, and then
    over one value of each slice, that costs n * sqrt(n) instead of n * n.
    """
    size = F.size(array)
    width = F.greatest(F.ceil(F.sqrt(size.cast("double"))).cast("int"), F.lit(1))
    return F.transform(
        F.sequence(F.lit(0), F.floor((size - 1) / width).cast("int")),
        lambda b: use(F.slice(array, b * width + 1, width)),
    )


def _fold(values: Column, join: Callable[[Column, Column], Column], kind: str) -> Column:
    """Running results over one short array."""
    none = F.array().cast(f"array<{kind}>")

    def step(out: Column, x: Column) -> Column:
        return F.concat(out, F.array(F.when(F.size(out) > 0, join(F.get(out, F.size(out) - 1), x)).otherwise(x)))

    return F.aggregate(values, none, step)


def running(
    values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b, kind: str = "int"
) -> Column:
    """Result of ``join`` (sum unless given; associative) over each value and all before it. Not for no values."""

    def joined(parts: Column) -> Column:
        ends = _fold(F.transform(parts, lambda p: F.element_at(p, -1)), join, kind)
        return let(
            ends,
            lambda upto: F.flatten(
                F.transform(
                    parts,
                    lambda p, i: F.when(i == 0, p).otherwise(
                        F.transform(p, lambda x: join(F.get(upto, i - 1), x))
                    ),
                )
            ),
        )

    folded = let(values, lambda v: blocks(v, lambda part: _fold(part, join, kind)))
    return let(folded, joined)


def cut(text: Column, spans: Column) -> Column:
    """The parts of a text at ascending spans (structs with start and end, code points), in order.

    A substring is found by counting from the start of its text, so spans are taken in slices, each
    from the part of the text that it covers.
    """

    def of(some: Column) -> Column:
        base = some[0]["start"]
        region = F.substring(text, base + 1, F.element_at(some, -1)["end"] - base)
        inside = lambda r: F.transform(
            some, lambda s: F.substring(r, s["start"] - base + 1, s["end"] - s["start"])
        )
        return let(region, inside)

    none = F.array().cast("array<string>")
    return let(
        spans, lambda held: F.when(F.size(held) > 0, F.flatten(blocks(held, of))).otherwise(none)
    )


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,found,part>>.

    start and end are code points, end exclusive; ``part`` is the given group. The
    text between the matches comes from splitting at the same pattern, and the
    positions are running sums of lengths.
    """
    kind = "array<struct<start:int,end:int,found:string,part:string>>"
    none = F.array().cast(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        parts = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        lengths = F.zip_with(
            F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit)
        )
        rows = F.arrays_zip(running(lengths).alias("end"), hits.alias("hit"), parts.alias("part"))
        return F.transform(
            rows,
            lambda r: F.struct(
                (r["end"] - F.length(r["hit"])).alias("start"),
                r["end"].alias("end"),
                r["hit"].alias("found"),
                r["part"].alias("part"),
            ),
        )

    return let(found, lambda hits: F.when(F.size(hits) > 0, located(hits)).otherwise(none))


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores behind it until no column has that name, in any case."""
    held = {c.lower() for c in taken}
    while wanted.lower() in held:
        wanted += "_"
    return wanted
