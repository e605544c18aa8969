"""Concatenate and cut: documents become one stream of token ids, cut every 2048.

Pass one tokenizes every document once, in Spark tasks, and writes its ids to the
shared folder together with its offset inside its partition. The partitions' token
totals, one row a partition, give each partition's offset in the whole stream by a
prefix sum. Pass two adds the two offsets and cuts every document at the multiples of
the sequence length that fall into it: a piece at a boundary belongs to the sequence
that its offset names. Only the last sequence of the stream is padded.

Words between blanks are tokenized independently of each other by the vocabularies
this is made for, so a worker keeps the ids of words it has seen, up to a fixed
number of words, and looks words up instead of tokenizing them again. Arrow splits a
shard's texts and tells its distinct words, so only those are looked up; pieces of words
are remembered apart, and longer than the words.

Defined results: a null or empty text is the end id alone; repeated rows are packed
like any other; a null id is carried along; extra columns are ignored; an empty table
gives no pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keybalance.llm import batches as B
from keybalance.workdir import written

LENGTH = 2048
END_ID = 1
#: Words, and pieces of words, whose ids one task remembers; then it starts over.
KNOWN_WORDS = 1 << 19


class _Numbers(dict):
    """Numbers words in the order in which they first come up."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies (a fixed mapping):
    printable Latin-1 characters stand for themselves, the other bytes follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


#: Words whose pieces are certain: Latin letters, then marks of punctuation. Lower-casing and
#: normal form concern each letter alone there, and the two runs are pieces of their own.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([.,;:!?#$%&*()-]*)")


def _raw(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class WordIds:
    """Token ids of words between blanks, remembered per word.

    ``arena`` holds the ids of all known words behind one another. Plain words go to
    the vocabulary's own model piece by piece, all others through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.letters = _byte_letters()
        self.by_piece = self._splits_like_words()
        self._forget()

    def _splits_like_words(self) -> bool:
        """Whether words may be taken apart: the tokenizer agrees on words of every kind."""
        samples = ["Word", "\u00c9t\u00e9", "no,", "\u00e9t\u00e9...", "x!?", "##", "a", "Stra\u00dfe;", "\u00d1and\u00fa):"]
        self.pieces: dict[str, bytes] = {}
        return all(
            self._plain(w) == _raw(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in samples
        )

    def _forget(self) -> None:
        self.known = _Numbers({None: 0})  # no word has number 0, which closes a text
        self.start = np.zeros(1 << 10, np.int32)
        self.start[1] = 1
        self.arena = np.full(1 << 12, END_ID, np.uint32)
        self.learned = self.used = 1

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            text = piece if piece.isascii() else piece.encode().decode("latin-1")
            tokens = self.tokenizer.model.tokenize(text.translate(self.letters))
            ids = self.pieces[piece] = _raw([t.id for t in tokens])
        return ids

    def _plain(self, word: str) -> bytes | None:
        m = _PLAIN.fullmatch(word)
        if m is None:
            return None
        letters, marks = m.groups()
        ids = self._piece(letters.lower()) if letters else b""
        return ids + self._piece(marks) if marks else ids

    def _learn(self, words: list[bytes]) -> None:
        if len(self.pieces) > self.limit:
            self.pieces = {}
        texts = [w.decode("utf-8", "replace") for w in words]
        lists = [self._plain(t) if self.by_piece else None for t in texts]
        other = [i for i, ids in enumerate(lists) if ids is None]
        encoded = self.tokenizer.encode_batch([texts[i] for i in other], add_special_tokens=False)
        for i, e in zip(other, encoded):
            lists[i] = _raw(e.ids)
        flat = np.frombuffer(b"".join(lists), np.uint32)
        need = self.learned + len(words) + 1
        if need > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(need, np.int32)])
        while self.used + len(flat) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.empty_like(self.arena)])
        self.start[self.learned + 1 : need] = self.used + np.cumsum([len(x) >> 2 for x in lists])
        self.arena[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.learned += len(words)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, each closed by END_ID, and the texts' bounds."""
        if self.learned > self.limit:
            self._forget()
        # Seen as text without a check: the split looks at single bytes. Two blanks enclose an empty word.
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        first = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary.view(pa.large_binary()).to_pylist()
        self.known.fresh = []
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        if self.known.fresh:
            self._learn(self.known.fresh)
        at = np.insert(number[coded.indices.to_numpy()], first[1:], 0)
        begin = self.start[at]
        size = self.start[at + 1] - begin
        before = np.concatenate([[0], np.cumsum(size)])
        bounds = before[first + np.arange(len(first))]  # one end id a text
        source = np.repeat(begin - before[:-1], size)
        source += np.arange(len(source))
        out = self.arena[source]
        return out, bounds


@cache
def _word_ids(path: str) -> WordIds:
    """One for all tasks of a worker process, as most words come up again."""
    return WordIds(path)


def tokenized(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part (partition), before (ids before it in its partition), tokens, ids (16 or 32 bits each)."""
    B.bound_batches(docs.sparkSession)
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().alias("part")
    )
    kind = dict(slim.dtypes)["doc_id"]

    def encode(parts: Iterator[pa.RecordBatch]):
        ids, total = _word_ids(tokenizer), 0
        for table in B.shards(parts):
            texts = [t.as_py() or b"" for t in table["text"].cast(pa.binary())]
            values, bounds = ids(texts)
            stored = values.astype("<u2") if values.max() < 1 << 16 else values.astype("<u4")
            width = stored.itemsize
            raw = pa.py_buffer(stored)
            offsets = pa.py_buffer((bounds * width).astype(np.int32))
            blob = pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets, raw])
            yield pa.RecordBatch.from_arrays(
                [
                    table["doc_id"].combine_chunks(),
                    table["part"].combine_chunks(),
                    pa.array(total + bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    blob,
                ],
                ["doc_id", "part", "before", "tokens", "ids"],
            )
            total += int(bounds[-1])

    return slim.mapInArrow(
        encode, f"doc_id {kind}, part int, before long, tokens long, ids binary"
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
) -> DataFrame:
    """One row per piece with its ids (little-endian, 32 bits each).

    doc_id, start, length, doc_tokens, sequence_id, offset, ids.
    """
    stored = written(tokenized(docs, tokenizer, doc_id, text), "tokens")
    totals = stored.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    bases, at = {}, 0  # one number a partition
    for row in totals:
        bases[row["part"]] = at
        at += row["n"]
    kind = dict(stored.dtypes)["doc_id"]

    def cut(parts: Iterator[pa.RecordBatch]):
        for batch in parts:
            base = np.array([bases[p] for p in batch.column("part").to_pylist()], np.int64)
            begin = base + batch.column("before").to_numpy()
            tokens = batch.column("tokens").to_numpy()
            first, last = begin // length, (begin + tokens - 1) // length
            count = last - first + 1
            doc = np.repeat(np.arange(batch.num_rows), count)
            sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            low = np.maximum(sequence * length, begin[doc])
            high = np.minimum((sequence + 1) * length, (begin + tokens)[doc])
            start = low - begin[doc]
            blobs = batch.column("ids")
            pieces = []
            wide, at = None, -1
            for d, a, b in zip(doc.tolist(), start.tolist(), (high - begin[doc]).tolist()):
                if d != at:
                    raw = blobs[d].as_buffer()
                    wide = np.frombuffer(raw, "<u2" if raw.size == 2 * tokens[d] else "<u4").astype("<u4")
                    at = d
                pieces.append(wide[a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(start),
                    pa.array(high - low),
                    pa.array(tokens[doc]),
                    pa.array(sequence),
                    pa.array(low - sequence * length),
                    pa.array(pieces, pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return stored.mapInArrow(
        cut,
        f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
