"""What a candidate key is: the requested columns, and one text form per value."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A candidate is a column name, or a tuple of names profiled as one composite key.
Candidate = str | tuple[str, ...]

# Values of these types can be grouped as they are: equal values have equal text
# and distinct values distinct text, but for zoned timestamps, where a repeated hour
# has one text for two instants. Everything else is grouped on its text, so that
# -0.0 / 0.0, NaN and nested values keep their own keys.
_GROUPED_NATIVELY = (
    T.BooleanType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.DecimalType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.BinaryType,
)
_NESTED = (T.ArrayType, T.StructType)


def column_ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def candidate_name(candidate: Candidate) -> str:
    return candidate if isinstance(candidate, str) else "|".join(candidate)


def parse_candidates(
    columns: str | Iterable[Candidate], available: Sequence[str]
) -> list[Candidate]:
    """Validate the requested columns; a string is a comma-separated list.

    Blanks are dropped, a tuple of one name is that name, and duplicates collapse to
    the first mention. An empty request, unknown columns and two candidates that
    would have one name are errors.
    """
    requested = columns.split(",") if isinstance(columns, str) else list(columns)
    cleaned = [c.strip() if isinstance(c, str) else tuple(p.strip() for p in c) for c in requested]
    plain = [c[0] if not isinstance(c, str) and len(c) == 1 else c for c in cleaned]
    candidates = list(dict.fromkeys(c for c in plain if c))
    if not candidates:
        raise ValueError("name at least one column to analyse")
    parts = [p for c in candidates for p in ((c,) if isinstance(c, str) else c)]
    missing = [p for p in dict.fromkeys(parts) if p not in available]
    if missing:
        raise ValueError(f"no such columns: {missing}; available: {list(available)}")
    names = [candidate_name(c) for c in candidates]
    if clash := [n for n in dict.fromkeys(names) if names.count(n) > 1]:
        raise ValueError(f"several candidates would be called {clash}; rename a column")
    return candidates


def holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype.fields)
    return False


def _text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)  # bytes that are not UTF-8 would collide in a cast
    if isinstance(dtype, _NESTED):
        return F.to_json(value)
    return value.cast("string")


def _part_text(value: Column, dtype: T.DataType) -> Column:
    """Text of one part of a composite key, escaped so that joining is one-to-one."""
    escaped = F.replace(
        F.replace(_text(value, dtype), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")
    )
    return F.coalesce(escaped, F.lit("\\N"))


@dataclass(frozen=True)
class Key:
    """One candidate: its name, the value to group on, and that value's text."""

    name: str
    value: Column
    group_type: T.DataType

    def text(self, grouped: Column) -> Column:
        return _text(grouped, self.group_type)


def resolve_key(df: DataFrame, candidate: Candidate) -> Key:
    """The grouping form of a candidate over ``df``."""
    names = (candidate,) if isinstance(candidate, str) else candidate
    types = [df.schema[n].dataType for n in names]
    for name, dtype in zip(names, types):
        if holds_map(dtype):
            raise ValueError(f"column {name!r}: map keys have no canonical text")
    refs = [column_ref(n) for n in names]
    if len(names) > 1:
        joined = F.concat_ws("|", *[_part_text(r, t) for r, t in zip(refs, types)])
        any_set = F.coalesce(*[F.when(r.isNotNull(), F.lit(True)) for r in refs])
        return Key(candidate_name(candidate), F.when(any_set, joined), T.StringType())
    dtype = types[0]
    if isinstance(dtype, _GROUPED_NATIVELY):
        return Key(names[0], refs[0], dtype)
    return Key(names[0], _text(refs[0], dtype), T.StringType())


def key_text(df: DataFrame, candidate: Candidate) -> Column:
    """The canonical key text of a candidate, per row."""
    key = resolve_key(df, candidate)
    return key.text(key.value)
