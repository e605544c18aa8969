"""Hash expressions of the sketch, and the row salt."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from keybalance.functions.keys import column_ref, holds_map


def sha256_cells(key: Column, width: int, depth: int) -> list[Column]:
    """Cell 0..width-1 of a key text in each of ``depth`` rows.

    A digest has eight numbers of 32 bits, one a row; further rows take the digest of the
    text with a suffix. Any engine can compute the same cells.
    """
    digests = [
        F.sha2(key if i == 0 else F.concat(key, F.lit(f"#{i}")), 256) for i in range(-(-depth // 8))
    ]
    part = lambda i: F.substring(digests[i // 8], 8 * (i % 8) + 1, 8)
    return [(F.conv(part(i), 16, 10).cast("bigint") % width).cast("int") for i in range(depth)]


def row_identity(df: DataFrame, identity: list[str] | None = None) -> list[Column]:
    """Columns that tell rows apart, repeatable when a task runs again.

    Named columns win. Otherwise a file scan's own row position is used: it
    separates exact copies and reads no further columns. Other inputs fall back
    to all their columns but maps, with a warning: copies of a row then stay together.
    """
    if identity:
        return [column_ref(c) for c in identity]
    position = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        df.select(*position).schema
        return position
    except AnalysisException:
        warnings.warn(
            "rows have no file position: copies of a row get one salt; name identity columns "
            "to tell them apart",
            stacklevel=2,
        )
        return [column_ref(f.name) for f in df.schema.fields if not holds_map(f.dataType)]


def row_salt(df: DataFrame, buckets: int, identity: list[str] | None = None) -> Column:
    """Salt 0..buckets-1 that splits equal keys. Not ``rand()``: a retried task must agree."""
    if buckets < 1:
        raise ValueError(f"need at least one salt, got {buckets}")
    return F.pmod(F.xxhash64(*row_identity(df, identity)), F.lit(buckets)).cast("int")
