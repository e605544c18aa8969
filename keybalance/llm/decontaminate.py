"""Benchmark decontamination with suffix arrays over shards of the training text.

The words of a shard (some MB of whole documents) become a suffix array, sorted by
prefix doubling to the depth of a window. Every test suffix is binary-searched in
every shard: its range in the array gives all places where its window stands
verbatim, and walking on from there gives the longest match. Shards are built and
searched where the documents lie; no document is shuffled.

The test words travel to the tasks in blocks of bounded size, one broadcast each; a
larger test set makes more blocks, and each shard is searched with all of them.

Words are compared by 64 bits of XXH3, not by a polynomial, so that no structure of a word makes
it equal to another.

Defined results: a null or empty text has no words, is not hit and is kept; an item
without words has no window; items with equal ids count once, a null id is written
``null``; repeated documents are judged alike; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keybalance.llm import batches as B
from keybalance.llm.suffixes import suffix_array

WIDTH = 13
#: Words of the test set in one broadcast block (8 bytes each, and 24 for each window).
BLOCK_WORDS = 1 << 20
#: A document is contaminated if hit words are at least one in so many.
ONE_IN = 20

#: Bytes of words: digits, letters and everything outside ASCII (A-Z is lower-cased before).
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

RESULT = (
    "n_words long, n_hit long, n_items long, items array<string>, contaminated boolean, "
    "longest_words long, longest_at long, longest_item string"
)


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the index of each text's first word (n + 1)."""
    data, bounds = B.flat(column)
    data = B.LOWER[data]
    starts, ends, first = B.words(_WORD[data], bounds)
    return B.word_hashes(data, starts, ends), first


class Block:
    """Test words of some items and their windows."""

    def __init__(self, items: list[str], words: np.ndarray, first: np.ndarray, width: int):
        sizes = np.diff(first)
        count = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
        self.items, self.words, self.width = items, words, width
        self.item = np.repeat(np.arange(len(items)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.start = first[:-1][self.item] + offset
        self.length = np.minimum(sizes[self.item], width)
        self.left = offset  # words of the item before the window
        self.right = sizes[self.item] - offset - self.length


def blocks(benchmark: DataFrame, item_id: str, text: str, width: int, size: int) -> Iterator[Block]:
    """The test set in blocks of about ``size`` words, read partition by partition."""
    names, texts, held = [], [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))

    def block() -> Block:
        words, first = tokens(pa.array(texts, pa.string()))
        return Block(names, words, first, width)

    for row in rows.toLocalIterator():
        names.append("null" if row["i"] is None else row["i"])
        texts.append(row["t"])
        held += len(row["t"] or "") // 4
        if held >= size:
            yield block()
            names, texts, held = [], [], 0
    if names:
        yield block()


class Shard:
    """Suffix array over the words of some documents."""

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int = WIDTH):
        docs = len(first) - 1
        # a separator, smaller than any word, behind each document
        place = np.arange(len(words)) + np.repeat(np.arange(docs), np.diff(first))
        self.vocabulary, inverse = np.unique(words, return_inverse=True)
        self.codes = np.zeros(len(words) + docs + depth, np.int64)
        self.codes[place] = inverse + 1
        self.first = first[:-1] + np.arange(docs)
        self.words = np.diff(first)
        self.size = len(words) + docs
        self.array = suffix_array(self.codes[: self.size], depth)

    def coded(self, words: np.ndarray) -> np.ndarray:
        """Codes of test words; -1 for words that the shard has not."""
        if not len(self.vocabulary):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def _bound(self, asked: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of all queries at once: where the suffixes that start with them begin or end."""
        low = np.zeros(len(asked), np.int64)
        high = np.full(len(asked), self.size, np.int64)
        rows = np.arange(len(asked))
        while len(rows):
            mid = (low[rows] + high[rows]) >> 1
            suffix = self.array[mid]
            right = np.full(len(rows), after)  # equal prefixes: go right for the end
            open_ = np.arange(len(rows))
            for k in range(asked.shape[1]):
                open_ = open_[length[rows[open_]] > k]
                if not len(open_):
                    break
                here, want = self.codes[suffix[open_] + k], asked[rows[open_], k]
                right[open_[here < want]] = True
                right[open_[here > want]] = False
                open_ = open_[here == want]
            low[rows[right]] = mid[right] + 1
            high[rows[~right]] = mid[~right]
            rows = rows[low[rows] < high[rows]]
        return low

    def find(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) for every place where a window of the block stands."""
        coded = np.concatenate([self.coded(block.words), np.zeros(block.width, np.int64)])
        asked = coded[block.start[:, None] + np.arange(block.width)]
        inside = np.arange(block.width) < block.length[:, None]
        here = np.flatnonzero(((asked > 0) | ~inside).all(axis=1))
        if not len(here):
            return here, here
        low = self._bound(asked[here], block.length[here], False)
        high = self._bound(asked[here], block.length[here], True)
        count = high - low
        window = np.repeat(here, count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return window, self.array[np.repeat(low, count) + offset]

    def extended(self, block: Block, window: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that match from each window's place on, to the end of its item at most."""
        coded = np.concatenate([self.coded(block.words), [0]])
        length = block.length[window].copy()
        limit = length + block.right[window]
        rows = np.flatnonzero(length < limit)
        while len(rows):
            at = place[rows] + length[rows]
            same = (at < self.size) & (
                self.codes[np.minimum(at, self.size - 1)]
                == coded[block.start[window[rows]] + length[rows]]
            )
            rows = rows[same]
            length[rows] += 1
            rows = rows[length[rows] < limit[rows]]
        return length


_TYPES = [
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("n_items", pa.int64()),
    ("items", pa.list_(pa.string())),
    ("contaminated", pa.bool_()),
    ("longest_words", pa.int64()),
    ("longest_at", pa.int64()),
    ("longest_item", pa.string()),
]


def judged(column, test: Iterable[Block], width: int = WIDTH) -> dict[str, list | np.ndarray]:
    """Contamination of each text of a shard."""
    words, first = tokens(column)
    shard = Shard(words, first, width)
    docs = len(first) - 1
    change = np.zeros(shard.size + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(docs)]
    best = np.zeros(docs, np.int64)
    best_at = np.full(docs, -1, np.int64)
    best_item: list[str | None] = [None] * docs
    for block in test:
        window, place = shard.find(block)
        if not len(window):
            continue
        change += np.bincount(place, minlength=len(change))
        change -= np.bincount(place + block.length[window], minlength=len(change))
        doc = np.searchsorted(shard.first, place, "right") - 1
        for d, i in np.unique(np.stack([doc, block.item[window]]), axis=1).T:
            items[d].add(block.items[i])
        length = shard.extended(block, window, place)
        order = np.lexsort((block.item[window], place, -length, doc))
        lead = order[np.unique(doc[order], return_index=True)[1]]
        for k in lead[length[lead] > best[doc[lead]]]:
            d = doc[k]
            best[d], best_at[d] = length[k], place[k] - shard.first[d]
            best_item[d] = block.items[block.item[window[k]]]
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    hit = covered[shard.first + shard.words] - covered[shard.first]
    return {
        "n_words": shard.words,
        "n_hit": hit,
        "n_items": np.array([len(s) for s in items], np.int64),
        "items": [sorted(s) for s in items],
        "contaminated": (hit > 0) & (ONE_IN * hit >= shard.words),
        "longest_words": best,
        "longest_at": [None if x < 0 else int(x) for x in best_at],
        "longest_item": best_item,
    }


def _test_set(benchmark: DataFrame, item_id: str, text: str, width: int, size: int) -> list:
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(b) for b in blocks(benchmark, item_id, text, width, size)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id and the columns of RESULT for every document."""
    B.bound_batches(docs.sparkSession)
    test = _test_set(benchmark, item_id, item_text, width, block_words)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def judge(parts):
        for shard in B.shards(parts):
            found = judged(shard["text"], (b.value for b in test), width)
            columns = [pa.array(found[name], t) for name, t in _TYPES]
            yield pa.RecordBatch.from_arrays(
                [shard["doc_id"].combine_chunks(), *columns], ["doc_id", *[n for n, _ in _TYPES]]
            )

    return slim.mapInArrow(judge, f"doc_id {kind}, {RESULT}")


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the contaminated documents, all columns kept."""
    B.bound_batches(docs.sparkSession)
    test = _test_set(benchmark, item_id, item_text, width, block_words)

    # tasks get columns by plain names: those with dots cannot be handed to Python
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    body = f"c{docs.columns.index(text)}"

    def keep(parts):
        for shard in B.shards(parts, column=body):
            found = judged(shard[body], (b.value for b in test), width)
            yield from shard.filter(pa.array(~found["contaminated"])).to_batches()

    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The result with the item list as a digest."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
