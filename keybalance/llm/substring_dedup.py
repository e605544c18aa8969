"""Substring dedup by word windows: Rabin-Karp hashes of every window, counted in Spark.

Every window of ``width`` words of one document is hashed. Hash ranges go to tasks,
and each task finds for every hash the smallest id it starts in; windows of other
documents with that hash are repeats. Repeats go back to their documents, where they
merge into maximal intervals of words to remove.

Before that shuffle, tasks resolve the windows of a group of texts (some MB) among
themselves: of the documents of a group that share a window only the smallest one
sends it, the others are repeats already. So a window that stands in a third of all
documents is sent once a group.

Windows are compared by 62 bits or more of a polynomial over 64-bit hashes of their words. Ids must be
integers.

Defined results: a null or empty text has no words; a null id counts as the smallest;
rows with equal ids never make repeats of each other, and each is judged for itself;
texts with fewer words than a window keep all; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keybalance.llm import batches as B, occurrences as O

WIDTH = 50


class Windows:
    """All windows of a group of texts: hash, document and first word of each."""

    def __init__(self, width: int):
        self.width = width
        self.ids, self.marks = [], []
        self.hashes, self.docs, self.starts = [], [], []
        self.count = self.size = 0

    def add(self, shard: pa.Table) -> None:
        data, bounds = B.flat(shard["text"])
        begin, end, first = B.words(~B.BLANK[data], bounds)
        hashes = B.Rolling(B.word_hashes(data, begin, end)).windows(self.width)
        words = np.diff(first)
        docs = np.repeat(np.arange(len(words)), words)
        inside = first[1:][docs] - np.arange(len(docs)) >= self.width
        at = np.flatnonzero(inside)
        self.hashes.append(hashes[at])
        self.docs.append((docs[at] + self.count).astype(np.int32))
        self.starts.append((at - first[:-1][docs[at]]).astype(np.int32))
        self.ids.append(B.ids(shard["doc_id"]))
        self.marks.append(O.text_marks(data, bounds))
        self.count += len(words)
        self.size += len(data)

    def resolved(self):
        """(ids, marks, hashes, docs, starts) and which windows repeat a smaller document's."""
        ids, marks = np.concatenate(self.ids), np.concatenate(self.marks)
        hashes, docs, starts = (np.concatenate(x) for x in (self.hashes, self.docs, self.starts))
        return ids, marks, hashes, docs, starts, later(hashes, ids[docs])


def later(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Occurrences whose hash also occurs with a smaller id."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    out = np.zeros(len(hashes), bool)
    if not len(hashes):
        return out
    same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
    shared = same.copy()
    shared[:-1] |= same[1:]
    order = order[shared]  # only hashes that occur twice
    if not len(order):
        return out
    at = O.starts_of(hashes[order])
    own = ids[order]
    least = np.repeat(np.minimum.reduceat(own, at), np.diff(np.append(at, len(order))))
    out[order[own > least]] = True
    return out


def _send(group: Windows, ranges: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A group's unresolved windows by hash range, and the verdicts it has found itself."""
    ids, marks, hashes, docs, starts, known = group.resolved()
    verdicts = O.Verdicts(buckets)
    verdicts.add(ids[docs[known]], marks[docs[known]], starts[known].astype(np.int64), np.full(known.sum(), group.width))
    for batch in verdicts.flush():
        n = batch.num_rows
        yield _row_batch(
            [int(b) % ranges for b in batch.column("bucket").to_pylist()],
            batch.column("bucket").to_pylist(), batch.column("spans").to_pylist(), [None] * n, [None] * n,
        )
    left = np.flatnonzero(~known)
    part = (hashes[left] >> np.uint64(64 - (ranges - 1).bit_length())).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
    left = left[np.argsort(part, kind="stable")]
    part = np.sort(part, kind="stable")
    at = O.starts_of(part)
    for piece, r in zip(np.split(left, at[1:]), part[at].tolist()) if len(left) else ():
        doc = O.starts_of(docs[piece])
        used = docs[piece][doc]
        count = np.diff(np.append(doc, len(piece)))
        low = np.ascontiguousarray(hashes[piece]).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
        place = starts[piece].astype("<u2" if starts[piece].max(initial=0) < 1 << 16 else "<u4")
        yield _row_batch(
            [r], [None], [O.packed(ids[used], marks[used], count)], [low], [place.tobytes()]
        )


SENT = "part int, bucket int, docs binary, hashes binary, places binary"


def _row_batch(part, bucket, docs, hashes, places) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(part, pa.int32()),
            pa.array(bucket, pa.int32()),
            pa.array(docs, pa.binary()),
            pa.array(hashes, pa.binary()),
            pa.array(places, pa.binary()),
        ],
        ["part", "bucket", "docs", "hashes", "places"],
    )


def _received(rows: list[dict]):
    """ids, marks, hashes and starts of all windows of one hash range."""
    ids, marks, hashes, starts = [], [], [], []
    for row in rows:
        i, m, count = O.unpacked(row["docs"])
        ids.append(np.repeat(i, count))
        marks.append(np.repeat(m, count))
        n = int(count.sum())
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :7] = np.frombuffer(row["hashes"], np.uint8).reshape(n, 7)
        hashes.append(wide.view(np.uint64).ravel())
        kind = "<u2" if len(row["places"]) == 2 * n else "<u4"
        starts.append(np.frombuffer(row["places"], kind).astype(np.int64))
    return tuple(np.concatenate(x) for x in (ids, marks, hashes, starts))


def repeats(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, int]:
    """Verdicts (spans of repeated windows per bucket of documents) and the number of buckets."""
    ranges = O.parts_of(docs)

    def send(parts):
        group = Windows(width)
        for shard in B.shards(parts):
            group.add(shard)
            if group.size >= O.GROUP_BYTES:
                yield from _send(group, ranges, ranges)
                group = Windows(width)
        if group.count:
            yield from _send(group, ranges, ranges)

    def judge(parts):
        now, held = None, []
        verdicts = O.Verdicts(ranges)

        def close():
            if held:
                ids, marks, hashes, starts = _received(held)
                known = later(hashes, ids)
                verdicts.add(ids[known], marks[known], starts[known], np.full(known.sum(), width))
                held.clear()

        for batch in parts:
            for row in batch.to_pylist():
                if row["part"] != now:
                    close()
                    yield from verdicts.flush()
                    now = row["part"]
                if row["hashes"] is None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["bucket"]], pa.int32()), pa.array([row["docs"]], pa.binary())],
                        ["bucket", "spans"],
                    )
                else:
                    held.append(row)
        close()
        yield from verdicts.flush()

    sent = docs.mapInArrow(send, SENT).repartitionById(ranges, F.col("part"))
    return sent.mapInArrow(judge, O.Verdicts.SCHEMA), ranges


RESULT = "n_words long, n_removed long, kept_text string, kept_sha256 string, intervals array<struct<start:long,end:long>>"


def merged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by the spans."""
    order = np.argsort(starts)
    begin, end = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:] - 1, len(end) - 1)]


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    with_text: bool = True,
) -> DataFrame:
    """doc_id and the columns of RESULT: words, removed words, what is left, removed intervals.

    The kept words are joined by one space; without ``with_text`` only their digest is given.
    """
    B.bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    verdicts, buckets = repeats(slim, width)
    kind = dict(slim.dtypes)["doc_id"]

    def apply(shard: pa.Table, found: dict):
        data, bounds = B.flat(shard["text"])
        raw = data.tobytes()
        ids, marks = B.ids(shard["doc_id"]), O.text_marks(data, bounds)
        total, gone, left, digests, intervals = [], [], [], [], []
        for i, m, a, b in zip(ids.tolist(), marks.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            words = raw[a:b].split()
            cut = []
            total.append(len(words))
            spans = found.get((i, m))
            if spans is not None:
                begin, end = merged(*spans)
                keep = np.ones(len(words), bool)
                for x, y in zip(begin.tolist(), end.tolist()):
                    keep[x:y] = False
                    cut.append({"start": x, "end": y})
                words = list(compress(words, keep.tolist()))
            kept = b" ".join(words)
            gone.append(total[-1] - len(words))
            digests.append(hashlib.sha256(kept).hexdigest())
            left.append(kept.decode("utf-8", "replace") if with_text else None)
            intervals.append(cut)
        yield pa.RecordBatch.from_arrays(
            [
                shard["doc_id"].combine_chunks(),
                pa.array(total, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array(left, pa.string()),
                pa.array(digests, pa.string()),
                pa.array(intervals, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "intervals"],
        )

    return O.reunited(slim, verdicts, buckets, apply, f"doc_id {kind}, {RESULT}")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
