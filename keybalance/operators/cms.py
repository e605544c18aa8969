"""Count-Min sketch as a table of cells: (column, row, cell, cnt)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keybalance.functions.hashing import sha256_cells
from keybalance.functions.keys import Candidate, candidate_name, column_ref, key_text, parse_candidates

BROADCAST_CELLS = 1 << 18


@dataclass(frozen=True)
class CmsShape:
    """Accuracy of a sketch and the table size that follows from it."""

    epsilon: float = 0.005
    delta: float = 0.01

    def __post_init__(self):
        for name, value in (("epsilon", self.epsilon), ("delta", self.delta)):
            if not 0 < value < 1:
                raise ValueError(f"{name} = {value} is not between 0 and 1")

    @property
    def width(self) -> int:
        return math.ceil(math.e / self.epsilon)

    @property
    def depth(self) -> int:
        return math.ceil(math.log(1.0 / self.delta))

    @property
    def memory_bytes(self) -> int:
        return self.depth * self.width * 8


def _hashed(keys: DataFrame, shape: CmsShape, *carry: str) -> DataFrame:
    """``keys`` exploded to the (row, cell) pairs of each key."""
    cells = F.array(*sha256_cells(F.col("key"), shape.width, shape.depth))
    return keys.where(F.col("key").isNotNull()).select(
        "column", *carry, F.posexplode(cells).alias("row", "cell")
    )


def _summed(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy("column", "row", "cell").agg(F.sum("n").cast("bigint").alias("cnt"))


def cms_cells(freq: DataFrame, shape: CmsShape = CmsShape()) -> DataFrame:
    """Sketch of a (weighted) frequency table; every distinct key is hashed once."""
    return _summed(_hashed(freq, shape, "n"))


class KeyTable:
    """Counts of a task's keys, hashed together when the table is full or the task ends.

    A key that repeats within the table is hashed once. The table holds ``SLOTS`` keys and
    ``SLOT_BYTES`` of their text at most; the cells are depth * width numbers.
    """

    SLOTS, SLOT_BYTES = 1 << 16, 32 << 20

    def __init__(self, shape: CmsShape):
        self.shape = shape
        self.counts: dict[str, int] = {}
        self.size = 0
        self.cells = np.zeros((shape.depth, shape.width), np.int64)

    def add(self, keys: pa.Array, counts: pa.Array) -> None:
        held = self.counts
        for key, n in zip(keys.to_pylist(), counts.to_pylist()):
            if key is None:
                continue
            before = held.get(key)
            if before is None:
                self.size += len(key)
                before = 0
            held[key] = before + n
            if len(held) >= self.SLOTS or self.size >= self.SLOT_BYTES:
                self.flush()

    def flush(self) -> None:
        """The table's keys go to their cells: eight numbers of 32 bits from each digest."""
        n = np.fromiter(self.counts.values(), np.int64, len(self.counts))
        for first in range(0, self.shape.depth, 8):
            suffix = f"#{first // 8}" if first else ""
            digests = b"".join(sha256(f"{k}{suffix}".encode()).digest() for k in self.counts)
            numbers = np.frombuffer(digests, ">u4").reshape(-1, 8).astype(np.int64) % self.shape.width
            for row in range(first, min(first + 8, self.shape.depth)):
                np.add.at(self.cells[row], numbers[:, row - first], n)
        self.counts.clear()
        self.size = 0

    def rows(self, column: str) -> pa.RecordBatch:
        self.flush()
        row, cell = np.nonzero(self.cells)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([column] * len(row), pa.string()),
                pa.array(row, pa.int32()),
                pa.array(cell, pa.int32()),
                pa.array(self.cells[row, cell]),
            ],
            names=["column", "row", "cell", "n"],
        )


def scan_cells(
    df: DataFrame,
    columns: str | Iterable[Candidate],
    shape: CmsShape = CmsShape(),
    weight: str | None = None,
) -> DataFrame:
    """Sketch straight from the rows: the shuffle carries depth * width cells a task, no keys.

    Tasks count equal keys of an Arrow batch first, then in a table of bounded size, and hash
    what the table holds: text is hashed once per distinct key and table, not once per row.
    """
    candidates = parse_candidates(columns, df.columns)
    names = [candidate_name(c) for c in candidates]
    inputs = [key_text(df, c).alias(f"k{i}") for i, c in enumerate(candidates)]
    if weight:
        w = column_ref(weight)
        checked = F.when(w < 1, F.raise_error(F.lit("weights must be at least 1"))).otherwise(w)
        inputs.append(checked.cast("bigint").alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [KeyTable(shape) for _ in names]
        for batch in batches:
            for i, table in enumerate(tables):
                if weight:
                    pairs = pa.table({"k": batch.column(i), "n": batch.column("n")})
                    summed = pairs.group_by("k").aggregate([("n", "sum")])
                    table.add(summed.column("k"), summed.column("n_sum"))
                else:
                    counted = pc.value_counts(batch.column(i))
                    table.add(counted.field("values"), counted.field("counts"))
        for name, table in zip(names, tables):
            yield table.rows(name)

    return _summed(df.select(*inputs).mapInArrow(count, "column string, row int, cell int, n bigint"))


def cms_total(cells: DataFrame) -> DataFrame:
    """(column, total_count): the sum of any one row of the sketch."""
    return (
        cells.where(F.col("row") == 0)
        .groupBy("column")
        .agg(F.sum("cnt").cast("bigint").alias("total_count"))
    )


def cms_merge(
    left: DataFrame, right: DataFrame, left_shape: CmsShape, right_shape: CmsShape
) -> DataFrame:
    """Cell-wise sum of two sketches of the same dimensions."""
    if (left_shape.width, left_shape.depth) != (right_shape.width, right_shape.depth):
        raise ValueError(f"cannot merge shapes {left_shape} and {right_shape}")
    return (
        left.unionByName(right)
        .groupBy("column", "row", "cell")
        .agg(F.sum("cnt").cast("bigint").alias("cnt"))
    )


def cms_estimate(
    cells: DataFrame, probes: DataFrame, shape: CmsShape = CmsShape()
) -> DataFrame:
    """(column, key, estimate) for the distinct probe keys (column, key).

    The sketch side of the join has at most depth * width rows per column whatever
    the size of the data behind it, so it is broadcast unless the shape itself is
    out of the ordinary.
    """
    side = F.broadcast(cells) if shape.depth * shape.width <= BROADCAST_CELLS else cells
    wanted = probes.select("column", "key").distinct()
    return (
        _hashed(wanted, shape, "key")
        .join(side, ["column", "row", "cell"], "left")
        .groupBy("column", "key")
        .agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))
    )
