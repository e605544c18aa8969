"""Ranked lexical search by NRA: impact-sorted reads with score intervals per document.

Every item of a query table is ranked against all documents. Terms are maximal runs of ASCII
letters and digits and of characters beyond ASCII, only A-Z lower-cased. With N documents
that hold a term, L terms in all, n in a document, df documents with a term and tf occurrences
of it in the document, a term adds w * ((10^9 tf) div (1000 tf + 8 m)) to the score, where
w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 10 + (90 n N) div L.

How it runs:

1. Items become distinct terms, in blocks of bounded size; a block is what tasks get at once.
2. One pass over the documents counts the block's terms in each, and writes the counts.
3. N, L and df come from what was written.
4. Documents go through tasks in shards. In a shard the postings of each term are sorted by
   impact, and an item's lists are read in step from the top. What was read of a document is
   the lower end of its score; the upper end adds, for each list in which it was not met yet, the
   next unread impact. Once no unmet document can reach the k-th lower end, reading goes on for
   the documents that still can, until their intervals are points. So membership, ties and scores
   are exact. The k-th score so far carries over to the task's next shards.
5. Each task returns k rows an item at most; a window ranks them. No task holds all postings of
   a term, so frequent terms need no treatment of their own.

Defined results: a null or empty text has no terms; a row of documents without terms counts
nowhere; every row is a document of its own, also with a repeated or null id, and null ids come first
among equal scores. Rows of items with one id, null included, are one item with the terms of all;
an item without terms or hits returns no row. Other columns, whatever their names, are not read.
Ids may be of any type that Spark can order, but must order alike in Python (numbers, text, dates).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from keybalance.functions.keys import column_ref
from keybalance.llm import batches as B
from keybalance.llm.native import text_of
from keybalance.workdir import written

TOP = 10
#: Bytes of distinct terms of items that one pass over the documents looks for. A block
#: holds whole items, so it is larger only if a single item is.
BLOCK_BYTES = 16 << 20
#: Postings that a shard holds at most, beyond its last document's.
SHARD_POSTINGS = 1 << 19
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20
#: How far lists are read in the first step, and how much farther in each one after it.
FIRST_DEPTH, STEP = 64, 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IS_TERM = [b >= 0x80 or chr(b).isalnum() for b in range(256)]
#: Bytes of terms in lower case, all others a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if ok else 32 for b, ok in enumerate(_IS_TERM))


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    lowered = F.translate(text_of(column_ref(text)), _UPPER, _LOWER)
    found = F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0))
    return items.select(column_ref(item_id).alias("item_id"), F.explode(found).alias("term")).distinct()


# ------------------------------------------------------------ counts of the wanted terms


def term_counts(raw: bytes) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each occurs."""
    clean, counts, n, start = raw.translate(_BYTES), Counter(), 0, 0
    while start < len(clean):
        end = clean.find(b" ", start + PIECE)
        end = len(clean) if end < 0 else end
        found = clean[start:end].split()
        n += len(found)
        counts.update(found)
        start = end
    return n, counts


def _counter(vocabulary, id_type: pa.DataType):
    """For ``mapInArrow``: per document its number of terms, and the wanted ones with their counts."""

    def count(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        wanted = number.keys()
        for batch in given:
            sizes, terms, often, ends = [], [], [], [0]
            for raw in batch.column("text").cast(pa.binary()):
                n, counts = term_counts(raw.as_py() or b"")
                found = [(number[t], counts[t]) for t in counts.keys() & wanted]
                terms += [t for t, _ in found]
                often += [c for _, c in found]
                sizes.append(n)
                ends.append(len(terms))
            bounds = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(id_type),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(bounds, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(bounds, pa.array(often, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tf"],
            )

    return count


# ------------------------------------------------------------ reading in order of impact


class Postings:
    """The postings of a shard, per term in descending order of impact."""

    def __init__(self, n: np.ndarray, bounds: np.ndarray, terms, tf, weights, documents, total):
        m = 10 + (n.astype(object) * (90 * documents) // total).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(bounds))
        impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        held = impact > 0
        terms, doc, impact = terms[held], doc[held], impact[held]
        order = np.lexsort((-impact, terms))
        self.doc, self.impact = doc[order], impact[order]
        self.bounds = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.size = len(n)

    def best(self, terms: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that can be among the first k and reach ``floor``.

        Scores are sums of integers below 2^53, so float64 holds them exactly.
        """
        start, end = self.bounds[terms], self.bounds[terms + 1]
        start, end = start[start < end], end[start < end]
        at, depth, among = start, FIRST_DEPTH, None
        doc = np.empty(0, np.int64)
        impact, of_list = np.empty(0, np.int64), np.empty(0, np.int64)
        while len(start):
            to = np.minimum(start + depth, end)
            new, its_list = _ranges(at, to)
            if among is not None:
                met = among[self.doc[new]]
                new, its_list = new[met], its_list[met]
            doc = np.concatenate([doc, self.doc[new]])
            impact = np.concatenate([impact, self.impact[new]])
            of_list = np.concatenate([of_list, its_list])
            unread = np.where(to < end, self.impact[np.minimum(to, end - 1)], 0)
            lower = np.bincount(doc, impact, self.size)
            upper = lower + unread.sum() - np.bincount(doc, unread[of_list], self.size)
            bound = max(floor, _kth(lower, k), 1)
            # An unmet document has no more than the unread tops of all lists.
            if among is not None or unread.sum() < bound:
                among = (lower > 0) & (upper >= bound)
                if (lower[among] == upper[among]).all():
                    found = np.flatnonzero(among)
                    return found, lower[found].astype(np.int64)
                met = among[doc]
                doc, impact, of_list = doc[met], impact[met], of_list[met]
            at, depth = to, depth * STEP
        return doc, impact


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start to its end, and the number of the range that each is in."""
    size = end - start
    which = np.repeat(np.arange(len(start)), size)
    return np.arange(size.sum()) + (start - np.cumsum(size) + size)[which], which


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest positive score; 0 if there are fewer."""
    scores = scores[scores > 0]
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _shards(given: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in given:
        ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + SHARD_POSTINGS - size, "right"))
            stop = min(max(stop, start + 1), batch.num_rows)
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop] - ends[start])
            start = stop
            if size >= SHARD_POSTINGS or start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _ranked(rows: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    """The first k of (score, id): larger scores, then smaller ids with null before all."""
    by_id = sorted(rows, key=lambda r: (r[1] is not None, r[1]) if r[1] is not None else (False,))
    return sorted(by_id, key=lambda r: -r[0])[:k]


def _searcher(block, k: int, id_type: pa.DataType):
    """For ``mapInArrow``: the first k documents of each item among all rows of the task."""

    def search(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, documents, total = block.value
        best: list[list[tuple[int, object]]] = [[] for _ in wanted]
        for shard in _shards(given):
            ids, lists = shard.column("doc_id"), pa.concat_arrays(shard.column("terms").chunks)
            tf = pa.concat_arrays(shard.column("tf").chunks).flatten().to_numpy()
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            postings = Postings(
                shard.column("n").to_numpy(),
                np.concatenate([[0], np.cumsum(sizes)]),
                lists.flatten().to_numpy(),
                tf,
                weights,
                documents,
                total,
            )
            for number, terms in enumerate(wanted):
                so_far = best[number]
                floor = so_far[-1][0] if len(so_far) == k else 0
                found, scores = postings.best(terms, floor, k)
                if len(found):
                    new = zip(scores.tolist(), (ids[int(d)].as_py() for d in found))
                    best[number] = _ranked([*so_far, *new], k)
        rows = [(number, score, i) for number, one in enumerate(best) for score, i in one]
        if rows:
            item, score, doc_id = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(doc_id, id_type), pa.array(score, pa.int64())],
                names=["item", "doc_id", "score"],
            )

    return search


# ------------------------------------------------------------ the operator


def _weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _search_block(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): what tasks return for one block of items."""
    spark = docs.sparkSession
    id_field = docs.schema["doc_id"]
    id_type = to_arrow_type(id_field.dataType)
    by_item: dict[object, list[str]] = {}
    for row in terms.collect():  # a block is bounded
        by_item.setdefault(row["item_id"], []).append(row["term"])
    items = list(by_item)
    number = {t: i for i, t in enumerate(sorted({t for own in by_item.values() for t in own}))}
    vocabulary = spark.sparkContext.broadcast({t.encode(): i for t, i in number.items()})

    id_ddl = id_field.dataType.simpleString()
    counted = docs.mapInArrow(
        _counter(vocabulary, id_type),
        f"doc_id {id_ddl}, n bigint, terms array<int>, tf array<bigint>",
    )
    counted = written(counted, "term-counts")
    held = F.col("n") > 0
    documents, total = counted.agg(F.count_if(held), F.sum("n")).first()
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(number), np.int64)
    for row in found:  # at most one row per term of the block
        weights[row["term"]] = _weight(row["count"], documents)
    wanted = [np.array(sorted(number[t] for t in by_item[i]), np.int64) for i in items]
    block = spark.sparkContext.broadcast((wanted, weights, documents, total))
    ranked = counted.where(F.size("terms") > 0).mapInArrow(
        _searcher(block, k, id_type), f"item int, doc_id {id_ddl}, score bigint"
    )
    names = spark.createDataFrame(
        list(enumerate(items)),
        T.StructType([T.StructField("item", T.IntegerType()), terms.schema["item_id"]]),
    )
    # As many names as the block has items.
    found = written(ranked.join(F.broadcast(names), "item").drop("item"), "search")
    vocabulary.destroy()
    block.destroy()
    return found


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item.

    Equal scores rank by ascending id. Documents with score 0 are not returned.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    spark = docs.sparkSession
    docs = docs.select(column_ref(doc_id).alias("doc_id"), column_ref(doc_text).alias("text"))
    terms = written(item_terms(items, item_id, item_text), "item-terms")
    size = terms.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    with B.small_batches(spark):
        for number in range(blocks):
            own = _search_block(docs, terms.where(block == number), k)
            found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
