"""How sources of a language differ in their words: distances of sources, and each one's own terms.

Terms are maximal runs of ASCII letters and of characters beyond ASCII, only A-Z lower-cased. Each
lang keeps the V terms that at least ``min_docs`` of its documents hold. With count occurrences of a
kept term in a (lang, source) group or in a whole lang, and N of all kept terms there, its share is
p = 1 + floor(10^9 (count + 5) / (N + 5 V)).

- Part ``pair``: for each group and each other source of its lang, the sum of the absolute
  differences of the shares of all kept terms (0 if there are none).
- Part ``term``: for each group, the kept terms it holds whose share is above the lang's, by the
  difference; ranks to ``top``.

How it runs:

1. Tasks count terms by sorting, in shards of texts. Terms of up to 8 bytes are one
   big-endian 64-bit word and those of up to 16 bytes two, so a least-significant-digit radix sort
   puts equal terms side by side, and runs are counted. Longer terms go to buckets by
   length, sorted as bytes. Shards are ordered by group and document before, so one
   stable sort gives occurrences per group and documents per group.
2. Spark sums the counts per (lang, source, term), and over the sources of each lang.
3. Distances: kept terms are cut into blocks and sources into tiles, both of bounded size. A task
   gets one block for two tiles and returns one partial sum for each pair of sources. A term that
   neither source of a pair holds adds what two counts of zero differ by; that is added once.

Defined results: a null text, lang or source is the empty string; each row is a document, also with
a repeated or null id (ids are not read); a group without terms has pairs and no terms; a lang with
one source has no pairs; no rows give no rows. Other columns, whatever their names, are not
read. A text longer than a shard is counted in pieces and counts as one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from keybalance.functions.keys import column_ref
from keybalance.llm import batches as B
from keybalance.workdir import written

#: Documents of a lang that must hold a term for it to count.
MIN_DOCS = 30
TOP = 50
#: Bytes of text that a task sorts at once.
SHARD_BYTES = 8 << 20
#: Terms of a block and sources of a tile, on average.
BLOCK_TERMS = 1024
TILE_SOURCES = 256
SCALE_STEPS, SCALE_STEP = 3, 1000  # a share is in units of 10^-9
PRIOR = 5

_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The first 0..8 bytes of a big-endian word.
_FIRST = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)
#: Longer terms are sorted as Python bytes, shorter long ones in buckets of fixed width.
_WIDEST = 1024

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


# ------------------------------------------------------------ counting by sorting


@dataclass
class Bucket:
    """Terms of like length: ``keys`` has one array per sort key, the first the most significant."""

    keys: list[np.ndarray]
    doc: np.ndarray
    n: np.ndarray

    def order(self) -> np.ndarray:
        if self.keys[0].dtype == np.uint64:
            return radix_order(self.keys)
        if self.keys[0].dtype == object:
            return np.array(sorted(range(len(self.doc)), key=self.keys[0].__getitem__), np.int64)
        return np.argsort(self.keys[0], kind="stable")

    def runs(self, group: np.ndarray) -> tuple[Bucket, np.ndarray]:
        """One entry per term and group of documents, ``doc`` its first, and how many documents it has.

        Documents ascend by group, and entries of one document stay in order.
        """
        order = self.order()
        keys, doc, n = [k[order] for k in self.keys], self.doc[order], self.n[order]
        new = np.ones(len(doc), bool)
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new_doc = new.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        new[1:] |= group[doc[1:]] != group[doc[:-1]]
        at = np.flatnonzero(new)
        counted = Bucket([k[at] for k in keys], doc[at], np.add.reduceat(n, at))
        return counted, np.add.reduceat(new_doc.astype(np.int64), at)

    def texts(self) -> pa.Array:
        if self.keys[0].dtype != np.uint64:
            return pa.array(self.keys[0].tolist(), pa.binary()).cast(pa.string())
        raw = np.stack(self.keys, 1).astype(">u8").view(np.uint8).reshape(len(self.doc), -1)
        held = raw != 0  # terms hold no zero byte
        ends = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(held.sum(1), out=ends[1:])
        data = np.ascontiguousarray(raw[held])
        return pa.StringArray.from_buffers(len(raw), pa.py_buffer(ends), pa.py_buffer(data))


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order of tuples of 64-bit words: counting sorts of 16-bit digits, the last digit first."""
    order = None
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if (digit == digit[0]).all():
                continue
            if order is None:
                order = np.argsort(digit, kind="stable")
            else:
                order = order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(words[0])) if order is None else order


def bucketed(data: np.ndarray, bounds: np.ndarray) -> list[Bucket]:
    """All terms of the texts behind one another in ``data``, in buckets by length."""
    start, end, first = B.words(_TERM[data], bounds)
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = B.LOWER[data]
    every8 = np.ndarray((len(data) + 9,), ">u8", padded, strides=(1,))
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    size = end - start
    found = []

    def add(chosen: np.ndarray, keys: list[np.ndarray]) -> None:
        found.append(Bucket(keys, doc[chosen], np.ones(len(chosen), np.int64)))

    word = lambda at, k: every8[at].astype(np.uint64) & _FIRST[k]
    if len(short := np.flatnonzero(size <= 8)):
        add(short, [word(start[short], size[short])])
    if len(middle := np.flatnonzero((size > 8) & (size <= 16))):
        add(middle, [word(start[middle], 8), word(start[middle] + 8, size[middle] - 8)])
    width = 16
    while width < _WIDEST:
        if len(long := np.flatnonzero((size > width) & (size <= 2 * width))):
            terms = [padded[a:b].tobytes() for a, b in zip(start[long], end[long])]
            add(long, [np.array(terms, f"S{2 * width}")])
        width *= 2
    if len(longest := np.flatnonzero(size > _WIDEST)):
        terms = np.empty(len(longest), object)
        terms[:] = [padded[a:b].tobytes() for a, b in zip(start[longest], end[longest])]
        add(longest, [terms])
    return found


def _merged(buckets: list[Bucket]) -> list[Bucket]:
    """Buckets with keys of one kind as one."""
    kinds: dict[tuple, list[Bucket]] = {}
    for b in buckets:
        kinds.setdefault((len(b.keys), b.keys[0].dtype), []).append(b)
    return [
        Bucket(
            [np.concatenate(k) for k in zip(*[b.keys for b in own])],
            np.concatenate([b.doc for b in own]),
            np.concatenate([b.n for b in own]),
        )
        for own in kinds.values()
    ]


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about a shard, cut where no term is."""
    start = 0
    while start < len(data):
        end = start + SHARD_BYTES
        while end < len(data) and _TERM[data[end : end + 4096]].all():
            end += 4096
        if end < len(data):
            end += int(np.argmin(_TERM[data[end : end + 4096]]))
        yield data[start:end]
        start = end


def shard_counts(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
    """(bucket, documents) of the texts, whose groups ascend."""
    if len(bounds) == 2 and len(data) > SHARD_BYTES:
        parts = []
        for piece in _pieces(data):
            for bucket in bucketed(piece, np.array([0, len(piece)])):
                parts.append(bucket.runs(group)[0])
        buckets = _merged(parts)
    else:
        buckets = bucketed(data, bounds)
    for bucket in buckets:
        yield bucket.runs(group)


def _count(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: ``COUNTS`` of each shard, and a row with an empty term for each group."""
    for shard in B.shards(given, SHARD_BYTES):
        lang, source = (shard.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        langs, sources = lang.dictionary, source.dictionary
        code = lang.indices.to_numpy().astype(np.int64) * len(sources) + source.indices.to_numpy()
        by_group = np.argsort(code, kind="stable")
        code = code[by_group]
        data, bounds = B.flat(shard.column("text").take(pa.array(by_group)))
        held, docs = np.unique(code, return_counts=True)
        none = pa.array(np.zeros(len(held), np.int64))
        rows = [(held, pa.array([""] * len(held), pa.string()), none, docs)]
        for bucket, documents in shard_counts(data, bounds, code):
            rows.append((code[bucket.doc], bucket.texts(), pa.array(bucket.n), documents))
        for group, term, n, documents in rows:
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(group // len(sources))),
                    sources.take(pa.array(group % len(sources))),
                    term,
                    n,
                    pa.array(documents),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


# ------------------------------------------------------------ shares


def kept_counts(docs: DataFrame, min_docs: int, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, in_lang, first): counts of kept terms, and an empty term per group.

    ``in_lang`` is the count over all sources; ``first`` marks one row of each (lang, term).
    """
    blank = lambda c, name: F.coalesce(column_ref(c), F.lit("")).alias(name)
    named = docs.select(blank(text, "text"), blank(lang, "lang"), blank(source, "source"))
    summed = (
        named.mapInArrow(_count, COUNTS)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    everywhere = Window.partitionBy("lang", "term")
    in_order = everywhere.orderBy("source")
    kept = summed.select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("n").over(everywhere).alias("in_lang"),
        (F.row_number().over(in_order) == 1).alias("first"),
        F.sum("docs").over(everywhere).alias("docs"),
    ).where((F.col("docs") >= min_docs) | (F.col("term") == ""))
    with B.small_batches(docs.sparkSession):
        return written(kept.drop("docs"), "kept-terms")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)) by long division, three digits a step.

    So nothing overflows 64 bits while a thousand times (total + 5 terms) does not.
    """
    rest, by = count + PRIOR, total + PRIOR * terms
    quotient = F.call_function("div", rest, by)
    for _ in range(SCALE_STEPS):
        rest = rest % by * SCALE_STEP
        quotient = quotient * SCALE_STEP + F.call_function("div", rest, by)
    return quotient + 1


def _shares(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups as (lang, source, total, terms, none), and their terms as (lang, source, term, p, q).

    ``none`` is the share of a count of zero, ``terms`` the V of the lang; p is the share of the
    term in the group and q in the lang.
    """
    is_term = F.col("term") != ""
    of_lang = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_total"), F.count_if(is_term & F.col("first")).alias("terms")
    )
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(of_lang, "lang")
    zero = F.lit(0).cast("bigint")
    none = F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(zero)
    terms = kept.where(is_term).join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    groups = groups.select("lang", "source", "total", "terms", none.alias("none"))
    return written(groups, "groups"), written(terms, "shares")


def own_terms(terms: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): terms with a larger share in the group than in the lang."""
    above = terms.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


# ------------------------------------------------------------ distances


def _distances(key: tuple, terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """For one block of terms and two tiles of sources: what the block adds to each pair's distance."""
    lang, block, low, high = key
    groups = groups.sort_values("source")
    names, none, tile = (groups[c].to_numpy() for c in ("source", "none", "tile"))
    place = {s: i for i, s in enumerate(names)}
    column = pd.factorize(terms["term"])[0]
    width = int(column.max()) + 1 if len(column) else 0
    p = np.repeat(none[:, None], width, 1)
    p[terms["source"].map(place).to_numpy(np.int64), column] = terms["p"].to_numpy()
    every = int(groups["terms"].iloc[0]) if block == 0 else 0
    left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    out = []
    for i in left:
        others = right[right > i] if low == high else right
        apart = np.abs(p[others] - p[i]).sum(1) + (every - width) * np.abs(none[others] - none[i])
        out.append((np.full(len(others), i), others, apart))
    a, b, value = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3
    first, second = np.minimum(a, b), np.maximum(a, b)
    return pd.DataFrame({"lang": lang, "a": names[first], "b": names[second], "value": value})


def distances(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each group and other source of its lang, how far apart they are.

    The result has all pairs of sources of a lang; what leads to it has one row for each pair,
    tile and block, however often terms occur.
    """
    cut = groups.groupBy("lang").agg(
        F.ceil(F.count(F.lit(1)) / TILE_SOURCES).cast("int").alias("tiles"),
        F.greatest(F.ceil(F.max("terms") / BLOCK_TERMS), F.lit(1)).cast("int").alias("blocks"),
    )
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")

    def for_tiles(rows: DataFrame) -> DataFrame:
        paired = rows.withColumn("tile", tile).withColumn("other", numbers(F.col("tiles")))
        return paired.withColumns(
            {"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}
        )

    sides = for_tiles(groups.join(cut, "lang")).withColumn("block", numbers(F.col("blocks"))).select(
        "lang", "block", "low", "high", "source", "tile", "terms", "none"
    )
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    cells = for_tiles(terms.join(cut, "lang")).select(
        "lang", block.alias("block"), "low", "high", "source", "term", "p"
    )
    by = ["lang", "block", "low", "high"]
    partial = (
        cells.groupBy(*by)
        .cogroup(sides.groupBy(*by))
        .applyInPandas(_distances, "lang string, a string, b string, value bigint")
    )
    summed = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    return summed.select("lang", F.inline(both), "value")


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources and terms of their own."""
    kept = kept_counts(docs, min_docs, text, lang, source)
    groups, terms = _shares(kept)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = distances(groups, terms).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair"))
        .select(*columns)
        .unionByName(own_terms(terms, top).withColumn("part", F.lit("term")).select(*columns))
    )
