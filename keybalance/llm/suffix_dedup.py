"""Removal of byte strings that occur before: sampled reduction, then induced suffix sorting.

A byte goes if a string of ``width`` bytes that covers it also starts earlier, in a
document with a smaller id or further left in the same one.

1. Reduction. As induced sorting first sorts a sampled, renamed text, every string of
   ``width`` bytes is assigned to a sample position inside it: the place of the smallest
   hash among the short strings (grams) it contains. Equal strings have equal sample
   positions, so strings can only meet where grams meet. Neighbouring strings with the
   same sample position form one context (the bytes that they cover), about 40 times
   fewer than bytes. Contexts go to tasks by hash ranges of their gram. A context
   that equals an earlier one is removed whole; a gram with one context has no repeats.
2. Induction. Contexts that share a gram and differ are partly equal. Only these are
   fetched, as bytes, to shards by gram, and each shard is sorted by induced suffix
   sorting (``suffixes.induced``): queues of (position, shared prefix) tuples, written
   to disk when large. Neighbours in the order that share ``width`` bytes or more are
   equal strings; all but the earliest of them are repeats.
3. A gram with very many contexts (a passage in a third of all documents, where each
   document goes on differently) is dealt over several shards. Each then passes on the first
   occurrence of each of its strings, and a group-by over their hashes finds the first
   over all shards.

Before the first shuffle, tasks resolve a group of texts (some MB) among themselves and
send one context per gram. Results go back to documents by buckets of ids.

Contexts are compared by 118 bits of hash, strings of split grams by 64.

Defined results: a null or empty text has no bytes; matches never cross documents;
texts shorter than ``width`` keep all; a null id counts as the smallest; rows
with one id and one text are one document and get the same result; rows with one
id and different texts are ordered by the hash of the text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keybalance.llm import batches as B, occurrences as O
from keybalance.llm.substring_dedup import merged
from keybalance.llm.suffixes import induced
from keybalance.workdir import written

WIDTH = 100
GRAM = 32
#: Contexts of one gram in one shard.
SPLIT = 4096
SORT_BYTES = 4 << 20
_SEGMENT = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)
#: What of a gram's hash is sent; its highest bits are those of the hash range.
_LOW = np.uint64((1 << 56) - 1)


def sampled(hashes: np.ndarray, count: int) -> np.ndarray:
    """For each start p the place of the smallest of hashes[p .. p + count - 1], the leftmost of equals.

    Forty bits of the hash decide. Minima of ``count`` values come from running minima of
    blocks of that size, forwards and backwards.
    """
    n = len(hashes) - count + 1
    out = np.empty(max(n, 0), np.int64)
    for s in range(0, n, _SEGMENT):
        e = min(s + _SEGMENT, n)
        own = hashes[s : e + count - 1]
        padded = np.full(-(-len(own) // count) * count, ~np.uint64(0))
        padded[: len(own)] = (own & ~_PLACE) | np.arange(len(own), dtype=np.uint64)
        blocks = padded.reshape(-1, count)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: e - s], ahead[count - 1 : count - 1 + e - s])
        out[s:e] = (least & _PLACE).astype(np.int64) + s
    return out


class Contexts:
    """Contexts of a group of texts: gram, context hash, document, start, gram's offset, extra bytes."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram
        self.ids, self.marks, self.rows = [], [], []
        self.count = self.size = 0

    def add(self, shard: pa.Table) -> None:
        data, bounds = B.flat(shard["text"])
        self.ids.append(B.ids(shard["doc_id"]))
        self.marks.append(O.text_marks(data, bounds).astype(np.int64))
        first_doc = self.count
        self.count += len(bounds) - 1
        self.size += len(data)
        if len(data) < self.width:
            return
        roll = B.Rolling(B.SYMBOL[data])
        grams = roll.windows(self.gram)
        at = sampled(grams, self.width - self.gram + 1)
        doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        valid = np.arange(len(at)) + self.width <= bounds[1:][doc[: len(at)]]
        p = np.flatnonzero(valid)
        if not len(p):
            return
        a = at[p]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
        begin, end, a = p[new], p[np.append(new[1:] - 1, len(p) - 1)], a[new]
        offset = a - begin
        whole = roll(begin, end + self.width)
        self.rows.append(
            (
                B.mixed(grams[a]),  # samples have small hashes; ranges need spread ones
                B.mixed(whole ^ B.SYMBOL[offset]),
                doc[begin] + np.int32(first_doc),
                (begin - bounds[doc[begin]]).astype(np.int64),
                offset.astype(np.uint8),
                (end - begin).astype(np.uint8),
            )
        )

    def all(self):
        empty = [np.empty(0, t) for t in (np.uint64, np.uint64, np.int32, np.int64, np.uint8, np.uint8)]
        rows = [np.concatenate(x) for x in zip(*self.rows)] if self.rows else empty
        return np.concatenate(self.ids), np.concatenate(self.marks), *rows


def later(keys: tuple[np.ndarray, ...], ids: np.ndarray, marks: np.ndarray, starts: np.ndarray):
    """Rows equal in all keys to a row with a smaller (id, mark, start), and per row the number of
    distinct keys that share its first key."""
    n = len(ids)
    repeat, kinds = np.zeros(n, bool), np.ones(n, np.int64)
    order = np.argsort(keys[0])
    same = np.zeros(n + 1, bool)
    ordered = keys[0][order]
    np.equal(ordered[1:], ordered[:-1], out=same[1:n]) if n else None
    rows = order[same[:n] | same[1:]]
    if not len(rows):
        return repeat, kinds
    rows = rows[np.lexsort([x[rows] for x in (starts, marks, ids, *keys[::-1])])]

    def changes(*columns):
        out = np.zeros(len(rows), bool)
        out[0] = True
        for c in columns:
            own = c[rows]
            out[1:] |= own[1:] != own[:-1]
        return out

    outer, inner = changes(keys[0]), changes(*keys)
    at = np.flatnonzero(inner)
    lead = np.repeat(rows[at], np.diff(np.append(at, len(rows))))
    repeat[rows] = (
        (ids[rows] != ids[lead]) | (marks[rows] != marks[lead]) | (starts[rows] != starts[lead])
    )
    group = np.flatnonzero(outer)
    kinds[rows] = np.repeat(
        np.add.reduceat(inner.astype(np.int64), group), np.diff(np.append(group, len(rows)))
    )
    return repeat, kinds


# ---------------------------------------------------------------- reduction

SENT = "part int, kind int, bucket int, docs binary, grams binary, contexts binary, places binary, shape binary"
DONE, OPEN, ENTRIES, SEVERAL = 0, 1, 2, 3
_SHIFT = 1024  # an open context's length also carries its gram's offset


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    binary = ("docs", "grams", "contexts", "places", "shape")
    return pa.RecordBatch.from_arrays(
        [
            *[pa.array(columns.get(c, [None] * n), pa.int32()) for c in ("part", "kind", "bucket")],
            *[pa.array(columns.get(c, [None] * n), pa.binary()) for c in binary],
        ],
        ["part", "kind", "bucket", *binary],
    )


def _ranged(grams: np.ndarray, ranges: int):
    """Rows by hash range: (range, indices) pairs."""
    part = (grams >> np.uint64(64 - (ranges - 1).bit_length())).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at = O.starts_of(part[order])
    if len(order):
        yield from zip(part[order][at].tolist(), np.split(order, at[1:]))


def _send(group: Contexts, ranges: int) -> Iterator[pa.RecordBatch]:
    ids, marks, grams, contexts, docs, starts, offset, extra = group.all()
    repeat, kinds = later((grams, contexts), ids[docs], marks[docs], starts)
    several = ~repeat & (kinds > 1)
    done, open_ = O.Verdicts(ranges), O.Verdicts(ranges)
    length = extra.astype(np.int64) + group.width
    done.add(ids[docs[repeat]], marks[docs[repeat]], starts[repeat], length[repeat])
    length += _SHIFT * offset.astype(np.int64)
    open_.add(ids[docs[several]], marks[docs[several]], starts[several], length[several])
    for kind, verdicts in ((DONE, done), (OPEN, open_)):
        for batch in verdicts.flush():
            bucket = batch.column("bucket").to_pylist()
            yield _rows(
                part=[b % ranges for b in bucket],
                kind=[kind] * len(bucket),
                bucket=bucket,
                docs=batch.column("spans").to_pylist(),
            )
    seen, first = np.unique(grams[several], return_index=True)
    for part, rows in _ranged(seen, ranges):
        yield _rows(
            part=[part],
            kind=[SEVERAL],
            grams=[seen[rows].tobytes()],
            docs=[O.packed(kinds[several][first[rows]])],
        )
    alone = np.flatnonzero(~repeat & (kinds == 1))
    for part, rows in _ranged(grams[alone], ranges):
        rows = np.sort(alone[rows])
        doc = O.starts_of(docs[rows])
        used = docs[rows][doc]
        count = np.diff(np.append(doc, len(rows)))
        kind = "<u2" if starts[rows].max() < 1 << 16 else "<u4" if starts[rows].max() < 1 << 32 else "<u8"
        yield _rows(
            part=[part],
            kind=[ENTRIES],
            docs=[O.packed(ids[used], marks[used], count)],
            grams=[grams[rows].view(np.uint8).reshape(-1, 8)[:, :7].tobytes()],
            contexts=[contexts[rows].tobytes()],
            places=[starts[rows].astype(kind).tobytes()],
            shape=[np.stack([offset[rows], extra[rows]]).tobytes()],
        )


class _Range:
    """What one hash range has received."""

    def __init__(self):
        self.entries, self.several = [], []

    def add(self, row: dict) -> None:
        if row["kind"] == SEVERAL:
            grams = np.frombuffer(row["grams"], np.uint64)
            self.several.append((grams & _LOW, O.unpacked(row["docs"])[0]))
            return
        ids, marks, count = O.unpacked(row["docs"])
        n = int(count.sum())
        grams = np.zeros((n, 8), np.uint8)
        grams[:, :7] = np.frombuffer(row["grams"], np.uint8).reshape(n, 7)
        size = len(row["places"]) // n
        shape = np.frombuffer(row["shape"], np.uint8).reshape(2, n)
        self.entries.append(
            (
                np.repeat(ids, count),
                np.repeat(marks, count),
                grams.view(np.uint64).ravel(),
                np.frombuffer(row["contexts"], np.uint64),
                np.frombuffer(row["places"], f"<u{size}").astype(np.int64),
                shape[0].astype(np.int64),
                shape[1].astype(np.int64),
            )
        )

    def judged(self, width: int, done: O.Verdicts, open_: O.Verdicts, split: int) -> np.ndarray:
        """Adds verdicts; gives (low 56 bits of the gram, contexts) of the grams to be split."""
        if self.entries:
            ids, marks, grams, contexts, starts, offset, extra = (
                np.concatenate(x) for x in zip(*self.entries)
            )
        else:
            ids = marks = starts = offset = extra = np.empty(0, np.int64)
            grams = contexts = np.empty(0, np.uint64)
        repeat, kinds = later((grams, contexts), ids, marks, starts)
        low = np.concatenate([x[0] for x in self.several] or [np.empty(0, np.uint64)])
        number = np.concatenate([x[1] for x in self.several] or [np.empty(0, np.int64)])
        known = np.isin(grams, low)
        several = ~repeat & ((kinds > 1) | known)
        length = extra + width
        done.add(ids[repeat], marks[repeat], starts[repeat], length[repeat])
        open_.add(ids[several], marks[several], starts[several], (length + _SHIFT * offset)[several])
        all_grams = np.concatenate([grams[several], low])
        value, where = np.unique(all_grams, return_inverse=True)
        total = np.bincount(where, np.concatenate([np.ones(several.sum()), number]), len(value))
        many = total > split
        return np.stack([value[many].view(np.int64), total[many].astype(np.int64)])


def _reduced(docs: DataFrame, ranges: int, width: int, gram: int, split: int) -> DataFrame:
    """bucket, kind (DONE, OPEN or SEVERAL), spans."""
    def send(parts):
        group = Contexts(width, gram)
        for shard in B.shards(parts):
            group.add(shard)
            if group.size >= O.GROUP_BYTES:
                yield from _send(group, ranges)
                group = Contexts(width, gram)
        if group.count:
            yield from _send(group, ranges)

    def batch(bucket, kind, spans):
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(spans, pa.binary())],
            ["bucket", "kind", "spans"],
        )

    def judge(parts):
        now, held = None, _Range()

        def close():
            done, open_ = O.Verdicts(ranges), O.Verdicts(ranges)
            many = held.judged(width, done, open_, split)
            for kind, verdicts in ((DONE, done), (OPEN, open_)):
                for b in verdicts.flush():
                    yield batch(b.column("bucket"), [kind] * b.num_rows, b.column("spans"))
            if many.size:
                yield batch([0], [SEVERAL], [many.tobytes()])

        for rows in parts:
            for row in rows.to_pylist():
                if row["part"] != now:
                    if now is not None:
                        yield from close()
                    now, held = row["part"], _Range()
                if row["kind"] in (DONE, OPEN):
                    yield batch([row["bucket"]], [row["kind"]], [row["docs"]])
                else:
                    held.add(row)
        if now is not None:
            yield from close()

    sent = docs.mapInArrow(send, SENT).repartitionById(ranges, F.col("part"))
    return sent.mapInArrow(judge, "bucket int, kind int, spans binary")


# ---------------------------------------------------------------- induction


def _low_gram(data: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """Low 56 bits of the hashes of the grams at the given places."""
    powers = B.powers(B._BASE, gram)
    total = np.zeros(len(at), np.uint64)
    for k in range(gram):
        total += B.SYMBOL[data[at + k]] * powers[k]
    return (B.mixed(B.mixed(total)) & _LOW).view(np.int64)


def _open_contexts(docs: DataFrame, verdicts: DataFrame, ranges: int, gram: int) -> DataFrame:
    """gram, id, mark, start, body of the contexts that are still open."""

    def fetch(shard: pa.Table, found: dict):
        data, bounds = B.flat(shard["text"])
        ids, marks = B.ids(shard["doc_id"]), O.text_marks(data, bounds)
        hit, spans, seen = [], [], set()
        for d, key in enumerate(zip(ids.tolist(), marks.tolist())):
            if key in found and key not in seen:
                seen.add(key)
                hit.append(d)
                spans.append(found[key])
        if not hit:
            return
        doc = np.repeat(hit, [len(s[0]) for s in spans])
        starts = np.concatenate([s[0] for s in spans])
        coded = np.concatenate([s[1] for s in spans])
        offset, length = coded // _SHIFT, coded % _SHIFT
        begin = bounds[doc] + starts
        ends = np.cumsum(length)
        body = data[np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]))]
        blob = pa.Array.from_buffers(
            pa.binary(),
            len(starts),
            [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(body)],
        )
        whole = pa.RecordBatch.from_arrays(
            [
                pa.array(_low_gram(data, begin + offset, gram)),
                pa.array(ids[doc]),
                pa.array(marks[doc].astype(np.int64)),
                pa.array(starts),
                blob,
            ],
            ["gram", "id", "mark", "start", "body"],
        )
        for k in range(0, whole.num_rows, 1 << 14):
            yield whole.slice(k, 1 << 14)

    return O.reunited(
        docs, verdicts, ranges, fetch, "gram long, id long, mark long, start long, body binary"
    )


def _dealt(contexts: DataFrame, reduced: DataFrame) -> DataFrame:
    """Contexts with the slot of their gram, 0 of 1 for all but the split grams."""
    many = reduced.where(F.col("kind") == SEVERAL).select("spans")
    if many.isEmpty():
        return contexts.withColumns({"slots": F.lit(1), "slot": F.lit(0)})

    def listed(parts):
        for batch in parts:
            for blob in batch.column("spans").to_pylist():
                value, total = np.frombuffer(blob, np.int64).reshape(2, -1)
                slots = (-(-total // SPLIT)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(slots)], ["gram", "slots"])

    table = many.mapInArrow(listed, "gram long, slots int").groupBy("gram").agg(F.max("slots").alias("slots"))
    slots = F.coalesce("slots", F.lit(1))
    return contexts.join(table, "gram", "left").select(
        *contexts.columns,
        slots.alias("slots"),
        F.pmod(F.xxhash64("id", "mark", "start"), slots).cast("int").alias("slot"),
    )


SORTED = "bucket int, kind int, spans binary, string long, id long, mark long, start long"


def _sorted_batch(bucket=(), spans=(), strings=None) -> pa.RecordBatch:
    if strings is None:
        n, none = len(bucket), pa.nulls(len(bucket), pa.int64())
        columns = [pa.array(bucket, pa.int32()), pa.array([DONE] * n, pa.int32()), pa.array(spans, pa.binary())]
        columns += [none] * 4
    else:
        n = len(strings[0])
        columns = [pa.nulls(n, pa.int32()), pa.array(np.full(n, OPEN, np.int32)), pa.nulls(n, pa.binary())]
        columns += [pa.array(x) for x in strings]
    return pa.RecordBatch.from_arrays(
        columns, ["bucket", "kind", "spans", "string", "id", "mark", "start"]
    )


def repeats_in(table: pa.Table, width: int):
    """Suffix-sorts the distinct contexts of a shard.

    Gives the spans (id, mark, start, length) of contexts that equal an earlier one, (id,
    mark, start) of the strings that repeat an earlier one, and those with
    their hash of the first occurrences in contexts of split grams.
    """
    data, bounds = B.flat(table["body"])
    length = np.diff(bounds)
    grams, hashes = table["gram"].to_numpy(), B.Rolling(B.SYMBOL[data])(bounds[:-1], bounds[1:])
    place = [table[c].to_numpy() for c in ("id", "mark", "start")]
    copy, _ = later((grams, hashes), *place)
    whole = (*[x[copy] for x in place], length[copy])
    table = table.filter(pa.array(~copy))
    data, bounds = B.flat(table["body"])
    length = np.diff(bounds)
    n = len(length)
    place = np.arange(len(data)) + np.repeat(np.arange(n), length)
    symbols = np.zeros(len(data) + n, np.uint16)
    symbols[place] = data.astype(np.uint16) + 1
    order, shared = induced(symbols, width)
    context = np.repeat(np.arange(n), length + 1)
    inside = np.arange(len(symbols)) - np.repeat(bounds[:-1] + np.arange(n), length + 1)
    valid = inside + width <= length[context]
    kept = valid[order]
    group = np.cumsum(shared < width)[kept]
    at = order[kept]
    ids, marks = table["id"].to_numpy(), table["mark"].to_numpy()
    starts = table["start"].to_numpy()[context[at]] + inside[at]
    ids, marks = ids[context[at]], marks[context[at]]
    repeat, _ = later((group,), ids, marks, starts)
    split = ~repeat & (table["slots"].to_numpy()[context[at]] > 1)
    hashes = np.empty(0, np.uint64)
    if split.any():
        padded = np.zeros(len(symbols), np.uint8)
        padded[place] = data
        hashes = B.Rolling(B.SYMBOL[padded])(at[split], at[split] + width)
    return whole, (ids[repeat], marks[repeat], starts[repeat]), (
        hashes.view(np.int64), ids[split], marks[split], starts[split],
    )


def joined_spans(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, width: int):
    """Strings at consecutive starts as one span: ids, marks, starts, lengths."""
    order = np.lexsort((starts, marks, ids))
    ids, marks, starts = ids[order], marks[order], starts[order]
    if not len(ids):
        return ids, marks, starts, starts
    far = np.concatenate(
        [[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (starts[1:] > starts[:-1] + 1)]
    )
    at = np.flatnonzero(far)
    last = np.append(at[1:], len(ids)) - 1
    return ids[at], marks[at], starts[at], starts[last] - starts[at] + width


def _sorted_shards(contexts: DataFrame, ranges: int, width: int, size: int) -> DataFrame:
    def sort(parts):
        verdicts = O.Verdicts(ranges)
        pending = 0

        def settle(table: pa.Table):
            nonlocal pending
            whole, repeat, first = repeats_in(table, width)
            spans = joined_spans(*repeat, width)
            verdicts.add(*whole)
            verdicts.add(*spans)
            pending += len(whole[0]) + len(spans[0])
            if len(first[0]):
                yield _sorted_batch(strings=first)
            if pending > 1 << 20:
                yield from flush()

        def flush():
            nonlocal pending
            pending = 0
            for b in verdicts.flush():
                yield _sorted_batch(b.column("bucket"), b.column("spans"))

        held, bytes_ = [], 0
        for batch in parts:
            held.append(batch)
            bytes_ += batch.column("body").nbytes
            if bytes_ < size:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table["gram"].to_numpy()
            slot = table["slot"].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (slot[1:] != slot[:-1])) + 1
            if len(cut):
                yield from settle(table.slice(0, int(cut[-1])))
                table = table.slice(int(cut[-1]))
            held, bytes_ = table.to_batches(), table["body"].nbytes
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks())
        yield from flush()

    dealt = contexts.repartition("gram", "slot").sortWithinPartitions("gram", "slot")
    return dealt.mapInArrow(sort, SORTED)


def _across(found: DataFrame, ranges: int, width: int) -> DataFrame:
    """Verdicts over the first strings of the shards of split grams."""
    strings = found.where(F.col("kind") == OPEN).select("string", F.struct("id", "mark", "start").alias("at"))
    first = strings.groupBy("string").agg(F.min("at").alias("first"))
    repeat = strings.join(first, "string").where("at > first").select("at.*")

    def spans(parts):
        verdicts = O.Verdicts(ranges)
        for batch in parts:
            own = [batch.column(c).to_numpy() for c in ("id", "mark", "start")]
            verdicts.add(*joined_spans(*own, width))
        yield from verdicts.flush()

    return repeat.mapInArrow(spans, O.Verdicts.SCHEMA)


# ---------------------------------------------------------------- result

RESULT = "n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    gram: int = GRAM,
    split: int = SPLIT,
    sort_bytes: int = SORT_BYTES,
    with_text: bool = True,
) -> DataFrame:
    """doc_id and the columns of RESULT; without ``with_text`` the kept bytes are left out."""
    if not 1 <= gram <= width <= 250:
        raise ValueError(f"need 1 <= gram <= width <= 250, got {gram} and {width}")
    spark = docs.sparkSession
    B.bound_batches(spark)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ranges = O.parts_of(slim)
    reduced = written(_reduced(slim, ranges, width, gram, split), "contexts")
    open_ = _open_contexts(
        slim, reduced.where(F.col("kind") == OPEN).select("bucket", "spans"), ranges, gram
    )
    found = written(_sorted_shards(_dealt(open_, reduced), ranges, width, sort_bytes), "suffixes")
    verdicts = (
        reduced.where(F.col("kind") == DONE)
        .select("bucket", "spans")
        .unionByName(found.where(F.col("kind") == DONE).select("bucket", "spans"))
        .unionByName(_across(found, ranges, width))
    )
    kind = dict(slim.dtypes)["doc_id"]

    def apply(shard: pa.Table, spans: dict):
        data, bounds = B.flat(shard["text"])
        raw = memoryview(np.ascontiguousarray(data))
        ids, marks = B.ids(shard["doc_id"]), O.text_marks(data, bounds)
        size, gone, runs, left, digests = [], [], [], [], []
        for i, m, a, b in zip(ids.tolist(), marks.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            cut = spans.get((i, m))
            begin, end = merged(*cut) if cut is not None else (np.empty(0, np.int64),) * 2
            at, pieces = 0, []
            for x, y in zip(begin.tolist(), end.tolist()):
                pieces.append(raw[a + at : a + x])
                at = y
            pieces.append(raw[a + at : b])
            digest = hashlib.sha256()
            for piece in pieces:
                digest.update(piece)
            size.append(b - a)
            gone.append(int((end - begin).sum()))
            runs.append(len(begin))
            left.append(b"".join(pieces) if with_text else None)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                shard["doc_id"].combine_chunks(),
                pa.array(size, pa.int64()),
                pa.array(gone, pa.int64()),
                pa.array(runs, pa.int64()),
                pa.array(left, pa.binary()),
                pa.array(digests, pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
        )

    return O.reunited(slim, verdicts, ranges, apply, f"doc_id {kind}, {RESULT}")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
