"""Shards of texts as flat byte arrays, for operators that work in numpy inside tasks."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

#: Rows that Spark hands to Python at once. Long texts make large batches, and the
#: setting counts rows only, so it is kept low; shards are put together from batches.
ROWS_PER_BATCH = 512
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHARD_BYTES = 2 << 20
LEAST = -(2**63)

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for A-Z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def bound_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Lower the session's rows per Arrow batch to ``rows`` if they are more."""
    if int(spark.conf.get(SETTING)) > rows:
        spark.conf.set(SETTING, str(rows))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> Iterator[None]:
    """Within it, jobs hand Python at most ``rows`` rows at once; the session's own setting returns."""
    before = spark.conf.get(SETTING)
    bound_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(SETTING, before)


def shards(
    batches: Iterable[pa.RecordBatch], target: int = SHARD_BYTES, column: str = "text"
) -> Iterator[pa.Table]:
    """Tables of whole rows with about ``target`` bytes of text; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start, n = 0, batch.num_rows
        while start < n:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + target - size, "right"))
            stop = min(max(stop, start if held else start + 1), n)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - base)
                start = stop
            if size >= target or start < n:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind one another as bytes, and where each begins (n + 1 bounds). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def ids(column: pa.ChunkedArray) -> np.ndarray:
    """Integer ids; null counts as the smallest."""
    return pc.fill_null(column.cast(pa.int64()), LEAST).to_numpy().astype(np.int64)


def words(is_word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, and per text the index of its first word (n + 1)."""
    n = len(is_word)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    starts = np.empty(n, bool)
    starts[0] = is_word[0]
    np.logical_and(is_word[1:], first[1:n] | ~is_word[:-1], out=starts[1:])
    ends = np.empty(n, bool)
    np.logical_and(is_word[:-1], first[1:n] | ~is_word[1:], out=ends[:-1])
    ends[-1] = is_word[-1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, bounds)


# ------------------------------------------------------------ polynomial hashes

#: An odd base, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) <= n:
        size = max(n + 1, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(steps)
    return known[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A 64-bit symbol for each byte.
SYMBOL = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


class Rolling:
    """Rabin-Karp hashes of any substrings of a sequence of 64-bit symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers(_BASE, n)[:n], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(self.prefix) - 1
        return mixed((self.prefix[ends] - self.prefix[starts]) * powers(_INVERSE, n)[starts])

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all windows of ``width`` symbols."""
        n = len(self.prefix) - 1
        if n < width:
            return np.empty(0, np.uint64)
        p = self.prefix
        return mixed((p[width:] - p[: n - width + 1]) * powers(_INVERSE, n)[: n - width + 1])


class _WordHashes(dict):
    """XXH3 of words. Frequent words are looked up; what is kept is bounded."""

    MOST, LONGEST = 1 << 18, 64

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = value
        return value


_WORDS = _WordHashes()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word. Not a polynomial: words of any length and structure tell apart."""
    raw = memoryview(np.ascontiguousarray(data)).tobytes()
    words = (raw[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(starts))
