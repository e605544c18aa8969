"""Shared by the two substring operators: routing occurrences by content, and verdicts back to texts.

A document is known by its id and 32 bits of its text's hash, so rows that share an id
but not a text stay apart. Occurrences travel as blobs: one row for a group of
documents and a range of hashes holds many occurrences, so Spark shuffles few large
rows instead of one row per window.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from keybalance.llm import batches as B

#: Bytes of text whose occurrences are resolved among themselves before any shuffle.
GROUP_BYTES = 16 << 20


#: Bytes of input files for one hash range; what a task holds of a range is a few times that.
RANGE_BYTES = 4 << 20
#: Ranges up to which they stay that small; beyond, one is up to WIDE_BYTES first.
MANY_RANGES, WIDE_BYTES = 1 << 18, 64 << 20
#: Sizes from here on stand for "not known" in a plan.
_UNKNOWN = 1 << 60


def input_bytes(docs: DataFrame) -> int | None:
    """Bytes of the tables that ``docs`` comes from, by Spark's plan; None where it does not know."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= _UNKNOWN for s in sizes) else sum(sizes)


def parts_of(docs: DataFrame) -> int:
    """Hash ranges, a power of two: so many that one holds a fixed share of the input.

    At least 64 and at least the session's shuffle partitions, which alone decide for input
    whose size is not known.
    """
    size = input_bytes(docs) or 0
    wanted = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_size = min(size // RANGE_BYTES, max(MANY_RANGES, size // WIDE_BYTES))
    return 1 << (max(wanted, by_size) - 1).bit_length()


def text_marks(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """32 bits of each text's hash."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.array(
        [xxhash.xxh32_intdigest(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())],
        np.uint32,
    )


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one blob: lengths, then differences, compressed."""
    out = []
    for a in arrays:
        a = np.asarray(a, np.int64)
        step = np.diff(a, prepend=0)
        out.append(np.array([len(a)], np.int64).tobytes())
        out.append(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())
    return zlib.compress(b"".join(out), 1)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw, out, at = zlib.decompress(blob), [], 0
    while at < len(raw):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        at += 8
        step = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T
        out.append(np.cumsum(np.ascontiguousarray(step).view(np.int64).ravel()))
        at += 8 * n
    return out


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def bucket_of(doc_ids: np.ndarray, buckets: int) -> np.ndarray:
    return (B.mixed(doc_ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


class Verdicts:
    """Spans (start, length) found for documents, gathered per bucket of documents."""

    SCHEMA = "bucket int, spans binary"

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        if len(ids):
            self.rows.append((ids, marks.astype(np.int64), starts, lengths))

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        ids, marks, starts, lengths = (np.concatenate(x) for x in zip(*self.rows))
        self.rows = []
        bucket = bucket_of(ids, self.buckets)
        order = np.lexsort((starts, marks, ids, bucket))
        at = starts_of(bucket[order])
        blobs = []
        for part in np.split(order, at[1:]):
            # documents once, with the number of their spans
            doc = np.flatnonzero(
                np.concatenate(
                    [[True], (ids[part][1:] != ids[part][:-1]) | (marks[part][1:] != marks[part][:-1])]
                )
            )
            count = np.diff(np.append(doc, len(part)))
            blobs.append(
                packed(ids[part][doc], marks[part][doc], count, starts[part], lengths[part])
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[order][at].astype(np.int32)), pa.array(blobs, pa.binary())],
            ["bucket", "spans"],
        )


def spans_by_document(blobs: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(id, text mark) -> starts, lengths."""
    held: dict[tuple[int, int], list] = {}
    for blob in blobs:
        ids, marks, count, starts, lengths = unpacked(blob)
        ends = np.cumsum(count)
        for i, m, a, b in zip(ids.tolist(), marks.tolist(), (ends - count).tolist(), ends.tolist()):
            held.setdefault((i, m), []).append((starts[a:b], lengths[a:b]))
    return {
        k: tuple(np.concatenate(x) for x in zip(*v)) if len(v) > 1 else v[0] for k, v in held.items()
    }


def reunited(
    docs: DataFrame,
    verdicts: DataFrame,
    buckets: int,
    use: Callable[[pa.Table, dict], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``use(shard of doc_id and text, spans by document)`` where verdicts meet their texts.

    Both sides go to buckets of documents in one shuffle; a bucket's verdicts come
    before its texts. A bucket is a set of ids, so it stays small whatever repeats.
    """
    texts = docs.select("doc_id", "text").mapInArrow(
        lambda parts: _with_bucket(parts, buckets), f"doc_id {dict(docs.dtypes)['doc_id']}, text binary, bucket int"
    )
    both = texts.select("bucket", F.lit(1).alias("kind"), "doc_id", F.col("text").alias("body")).unionByName(
        verdicts.select(
            "bucket",
            F.lit(0).alias("kind"),
            F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"),
            F.col("spans").alias("body"),
        )
    )
    dealt = both.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")

    def meet(parts):
        def run(bucket_rows: pa.Table, found: dict):
            for shard in B.shards(bucket_rows.to_batches(), column="body"):
                yield from use(shard.rename_columns(["doc_id", "text"]), found)

        now, blobs, found = None, [], None
        for batch in parts:
            keys = batch.column("bucket").to_numpy()
            kinds = batch.column("kind").to_numpy()
            cuts = starts_of(keys * 2 + kinds)
            for a, b in zip(cuts, np.append(cuts[1:], len(keys))):
                piece = batch.slice(a, b - a)
                if keys[a] != now:
                    now, blobs, found = keys[a], [], None
                if kinds[a] == 0:
                    blobs += piece.column("body").to_pylist()
                else:
                    if found is None:
                        found = spans_by_document(blobs)
                    yield from run(pa.table(piece.select(["doc_id", "body"])), found)

    return dealt.mapInArrow(meet, schema)


def _with_bucket(parts, buckets: int):
    for batch in parts:
        bucket = bucket_of(B.ids(batch.column("doc_id")), buckets).astype(np.int32)
        text = batch.column("text")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), text.cast(pa.binary()), pa.array(bucket)],
            ["doc_id", "text", "bucket"],
        )
