"""SimHash near-duplicates: fingerprints, bit-sliced comparison, connected components.

A fingerprint has a bit for each position that is set in over half of the hashes of a
text's word shingles. Two fingerprints within ``radius`` bits are linked. By the
pigeonhole principle they agree in at least two of ``radius + 2`` blocks of bits, so
comparing inside the buckets of equal block pairs finds every link.

Inside a bucket, fingerprints stand vertically: plane b holds bit b of 64 of them in
one word. A fingerprint is compared with 64 others at once by XOR of the planes and a
carry-save counter of the differing bits, three bits of count for 64 lanes; blocks of lanes
whose counts all exceed the radius are abandoned. Equal fingerprints are one before
that, and a bucket with many distinct ones is dealt over cells, one for each pair of
its slots, so no task holds a whole large bucket. A cell passes on a spanning forest
of its links, not the links.

Components come from alternating large-star and small-star steps over those forests,
each written to the shared folder.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is
linked like any other; a null id takes part but names a component only if no other
id does; repeated rows are copies of each other; extra columns are kept by
``drop_near_duplicates`` and ignored by ``components``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from keybalance.llm import batches as B
from keybalance.workdir import written

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Distinct fingerprints of one bucket that one slot takes.
SLOT = 2048
#: Comparisons (one fingerprint with 64 others) held in memory at once.
CHUNK = 1 << 16
ALL = np.uint64(2**64 - 1)
ONE = np.uint64(1)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [
        digest(joined[a:b], SEED)
        for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    ]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE
) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""
    B.bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def hashed(parts):
        for batch in parts:
            fps = [fingerprint(t.as_py() or b"", width) for t in batch.column("text")]
            values = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"]
            )

    return slim.mapInArrow(hashed, f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- comparison


def planes(values: np.ndarray) -> np.ndarray:
    """64 x words: bit b of value i is bit i % 64 of word i // 64 in plane b."""
    n = len(values)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _ones(count: np.ndarray) -> np.ndarray:
    """Words with the lowest ``count`` bits set (0 to 64)."""
    shift = (64 - np.maximum(count, 1)).astype(np.uint64)
    return np.where(count > 0, ALL >> shift, np.uint64(0))


def near_lanes(
    values: np.ndarray, sliced: np.ndarray, row: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray]:
    """(row, lane) pairs within ``radius`` bits; row i is compared with the lanes of word[i]."""
    if not 0 <= radius < 8:
        raise ValueError("the counter has three bits: radius must be 0 to 7")
    ones, twos, fours = (np.zeros(len(row), np.uint64) for _ in range(3))
    over = ~lanes
    own = values[row]
    for b in range(64):
        differ = sliced[b][word] ^ (np.uint64(0) - ((own >> np.uint64(b)) & ONE))
        carry = ones & differ
        ones ^= differ
        differ = twos & carry
        twos ^= carry
        carry = fours & differ
        fours ^= differ
        over |= carry
        if b >= radius:
            over |= _above(ones, twos, fours, radius)
            if b % 4 == 3:
                open_ = over != ALL
                if not open_.all():
                    row, word, own, over = row[open_], word[open_], own[open_], over[open_]
                    ones, twos, fours = ones[open_], twos[open_], fours[open_]
                    if not len(row):
                        break
    near = ~over
    some = np.flatnonzero(near)
    bits = np.unpackbits(near[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, lane = np.nonzero(bits)
    return row[some[which]], word[some[which]] * 64 + lane


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is larger than ``radius``."""
    larger, equal = np.zeros_like(ones), np.full_like(ones, ALL)
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal &= plane
        else:
            larger |= equal & plane
            equal &= ~plane
    return larger


def forest(values: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int) -> np.ndarray:
    """Label per lane: the smallest lane it is linked to, value i being compared with lanes low[i] to high[i]."""
    n = len(values)
    label = np.arange(n)
    low, high = np.maximum(low, 0), np.minimum(high, n)
    first = low >> 6
    count = np.where(high > low, ((high - 1) >> 6) - first + 1, 0)
    sliced = planes(values)
    ends = np.cumsum(count)
    at, total = 0, int(ends[-1]) if n else 0
    while at < total:
        blocks = np.arange(at, min(at + CHUNK, total))
        row = np.searchsorted(ends, blocks, "right")
        word = first[row] + blocks - (ends[row] - count[row])
        lanes = _ones(np.minimum(high[row] - word * 64, 64)) & ~_ones(
            np.clip(low[row] - word * 64, 0, 64)
        )
        _union(label, *near_lanes(values, sliced, row, word, lanes, radius))
        at += CHUNK
    return label


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of the linked lanes; labels end at the smallest lane."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            next_ = label[label]
            if np.array_equal(next_, label):
                break
            label[:] = next_


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of radius + 2 blocks of the 64 bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _bucket_keys(fp: Column, radius: int) -> Column:
    parts = [
        F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        for shift, bits in _blocks(radius)
    ]
    widest = max(bits for _, bits in _blocks(radius))
    keys = []
    for i, (a, b) in enumerate(combinations(range(len(parts)), 2)):
        pair = F.shiftleft(parts[a], widest).bitwiseOR(parts[b])
        keys.append(pair.bitwiseOR(F.lit(i << (2 * widest)).cast("long")))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, slot: int = SLOT) -> DataFrame:
    """Spanning links a > b between the distinct fingerprints of column fp."""
    buckets = distinct.select("fp", F.explode(_bucket_keys(F.col("fp"), radius)).alias("key"))
    full = (
        buckets.groupBy("key")
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > 1)
        .select("key", F.ceil(F.col("size") / slot).cast("int").alias("slots"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int")
    cells = (
        buckets.join(full, "key")
        .select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("other"))
        .select(
            "fp",
            "key",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
    )
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def compare(parts):
        held, size = [], 0
        for batch in parts:  # whole cells only are compared
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 17:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = _last_cell(table)
                if cut:
                    yield from _cell_links(table.slice(0, cut), radius)
                    table = table.slice(cut)
                held, size = table.to_batches(), table.num_rows
        if held:
            yield from _cell_links(pa.Table.from_batches(held).combine_chunks(), radius)

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _cell_starts(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in ("key", "i", "j"):
        column = table[name].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _last_cell(table: pa.Table) -> int:
    return int(_cell_starts(table)[-1])


def _cell_links(table: pa.Table, radius: int):
    n = table.num_rows
    if not n:
        return
    values = table["fp"].to_numpy().view(np.uint64)
    starts = _cell_starts(table)
    size = np.diff(np.append(starts, n))
    end = np.repeat(starts + size, size)
    side = table["side"].to_numpy()
    between = table["i"].to_numpy() != table["j"].to_numpy()
    # within a slot: every later lane of the cell; between slots: the other side's lanes
    other = np.repeat(starts + size - np.add.reduceat(side, starts), size)
    low = np.where(between, other, np.arange(n) + 1)
    high = np.where(between & (side == 1), 0, end)
    label = forest(values, low, high, radius)
    linked = np.flatnonzero(label != np.arange(n))
    signed = values.view(np.int64)
    a, b = signed[linked], signed[label[linked]]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"]
    )


# ---------------------------------------------------------------- components


def connected(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) for every node of the edges a, b.

    Alternates large-star and small-star steps until nothing changes; every round is
    written, so a lost executor repeats one round at most.
    """
    now = written(edges.where("a <> b"), "edges")
    state = _state(now)
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_least, "a")
            .select(F.inline(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            )))
            .where("a <> b")
            .distinct()
        )
        now = written(small, "edges")
        new = _state(now)
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))
    ).first()
    return tuple(row)


def components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) and root (its fingerprint) of every document."""
    hashed = written(fingerprints(docs, doc_id, text, width), "fingerprints")
    distinct = hashed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = written(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id", "root")
    return hashed.join(by_fp, "fp").select("doc_id", "fp", "component_id", "root")


def drop_near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = SHINGLE,
    radius: int = RADIUS,
    by_id: bool = True,
) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows are told apart by id and fingerprint, so an id that stands for unlike texts keeps
    no copy of another document in place of its own. Of a component's equal rows by that, and
    of a component without any id, one stays, the same in every run. With ``by_id`` at
    most one row of an id stays; without, unlike texts of one id all stay.
    """
    found = components(docs, doc_id, text, width, radius)
    key = lambda c: [F.coalesce(c.cast("string"), F.lit("")), c.isNull()]
    # tasks get columns by plain names: those with dots cannot be handed to Python
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    names = id_, none, fp = ["_id", "_none", "_fp"]
    body = f"c{columns.index(text)}"

    keep = (
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "component_id")
        .agg(F.min("fp").alias(fp))
        .select(*[c.alias(n) for c, n in zip(key(F.col("component_id")), (id_, none))], fp)
    )

    def marked(parts):
        for batch in parts:
            texts = batch.column(body).cast(pa.binary())
            fps = [fingerprint(t.as_py() or b"", width) for t in texts]
            yield batch.append_column(fp, pa.array(np.array(fps, np.uint64).view(np.int64)))

    schema = T.StructType([*plain.schema.fields, T.StructField(fp, T.LongType())])
    own = [c.alias(n) for c, n in zip(key(F.col(f"c{columns.index(doc_id)}")), (id_, none))]
    row = F.struct(*plain.columns)
    kept = (
        plain.mapInArrow(marked, schema)
        .select(row.alias("row"), *own, fp)
        .join(keep, names, "left_semi")
    )
    # grouped by the columns of the join: dropping repeats moves nothing
    last = F.when(F.col(none), F.col(fp)).alias(fp) if by_id else fp
    order = F.struct(F.col(fp), F.xxhash64(F.to_json("row")))
    single = kept.groupBy(id_, none, last).agg(F.min_by("row", order).alias("row"))
    return single.select("row.*").toDF(*columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
