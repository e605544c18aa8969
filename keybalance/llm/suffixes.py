"""Suffix sorting inside a task: prefix doubling, and induced sorting with common prefixes.

``induced`` sorts the suffixes of a text in the induced-sorting way. Suffixes are of
type S or L by whether they are smaller or larger than the one behind them. The
leftmost S suffixes (about a third) are named by the symbols up to the next of them;
the text of names is sorted first, and all other suffixes follow from that
order: a scan in ascending order puts the L suffixes into a queue by first symbol, one
in descending order the S suffixes. Every queue entry is a tuple of a position and the
length of the prefix it shares with the entry before it; the shared prefix of two
entries is one more than the smallest one passed in the scan between their sources.

A shard has to fit in memory: its text with a key of eight bytes for each position, the L
entries of all symbols and the whole order stay there. Only a queue can write its blocks to
an unlinked file, once they outgrow ``QUEUE_BYTES``. An entry has five bytes, so the shards
that ``suffix_dedup`` cuts at 4 MB never get there, and no shard larger than memory can
be sorted. Scans work on whole blocks in numpy.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Symbols of nine bits: 0 is the separator, a byte b is b + 1, 511 marks a name's end.
BITS, PER_KEY, END = 9, 7, 511
SYMBOLS = 257
QUEUE_BYTES = 64 << 20


# ---------------------------------------------------------------- prefix doubling


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and the dense rank of each."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), np.int64)
    step = np.empty(len(keys), bool)
    step[:1] = False
    np.not_equal(ordered[1:], ordered[:-1], out=step[1:])
    new[order] = np.cumsum(step)
    return order, new


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` in the order of their first ``depth`` symbols or more."""
    n = len(codes)
    bits = int(codes.max(initial=1)).bit_length()
    reach = max(1, min(depth, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(reach):  # the first symbols fit into one key
        key <<= bits
        key[: max(n - k, 0)] |= codes[k:]
    order, rank = ranks(key)
    while reach < depth and n and rank[order[-1]] < n - 1:
        step = min(reach, depth - reach)  # overlapping at the end: depth symbols exactly
        behind = np.zeros(n, np.int64)
        behind[: max(n - step, 0)] = rank[step:] + 1
        order, rank = ranks(rank * (n + 1) + behind)
        reach += step
    return order


# ---------------------------------------------------------------- induced sorting


class Queue:
    """Tuples (position, shared prefix) by first symbol, in the order of their arrival."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.limit, self.held = limit, 0
        self.blocks: list[list] = [[] for _ in range(SYMBOLS)]
        self.file = None

    def push(self, symbol: int, positions: np.ndarray, shared: np.ndarray) -> None:
        self.blocks[symbol].append((positions, shared))
        self.held += positions.nbytes + shared.nbytes
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.file = tempfile.TemporaryFile(dir=folder if folder and os.path.isdir(folder) else None)
        for blocks in self.blocks:
            for i, block in enumerate(blocks):
                if isinstance(block[0], np.ndarray):
                    at = self.file.seek(0, os.SEEK_END)
                    self.file.write(block[0].tobytes())
                    self.file.write(block[1].tobytes())
                    blocks[i] = (at, len(block[0]))
        self.held = 0

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        blocks, self.blocks[symbol] = self.blocks[symbol], []
        read = []
        for a, b in blocks:
            if isinstance(a, np.ndarray):
                self.held -= a.nbytes + b.nbytes
            else:
                self.file.seek(a)
                a, b = (
                    np.frombuffer(self.file.read(4 * b), np.int32),
                    np.frombuffer(self.file.read(b), np.uint8),
                )
            read.append((a, b))
        if not read:
            return np.empty(0, np.int32), np.empty(0, np.uint8)
        positions, shared = zip(*read)
        return np.concatenate(positions), np.concatenate(shared)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Text:
    """A text of symbols that ends in 0, with seven symbols from each position in one key."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.n, self.depth = len(symbols), depth
        self.symbols = np.zeros(self.n + depth + 2 * PER_KEY, np.uint16)
        self.symbols[: self.n] = symbols
        self.keys = np.zeros(self.n + depth + PER_KEY, np.int64)
        for k in range(PER_KEY):
            self.keys <<= BITS
            self.keys |= self.symbols[k : k + len(self.keys)]
        s = self.symbols[: self.n]
        at = np.where(s[1:] != s[:-1], np.arange(self.n - 1), self.n)
        at = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
        self.small = np.ones(self.n, bool)
        inside = at < self.n
        self.small[:-1][inside] = s[at[inside]] < s[at[inside] + 1]

    def leftmost(self) -> np.ndarray:
        return np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b have in common, ``depth`` at most."""
        out = np.zeros(len(a), np.int64)
        rows = np.arange(len(a))
        limits = np.left_shift(np.int64(1), np.arange(BITS, 63, BITS))
        for k in range(0, self.depth, PER_KEY):
            x = self.keys[a[rows] + k] ^ self.keys[b[rows] + k]
            out[rows] += np.where(x == 0, PER_KEY, PER_KEY - 1 - np.searchsorted(limits, x, "right"))
            rows = rows[x == 0]
            if not len(rows):
                break
        return np.minimum(out, self.depth).astype(np.uint8)

    def names(self, at: np.ndarray) -> np.ndarray:
        """Dense ranks of the strings from each given position up to the next one, both included.

        A string that another one continues is the larger: it ends in an S symbol where
        the other goes on with an L symbol. So its end counts as the largest symbol.
        """
        length = np.append(np.diff(at) + 1, PER_KEY)  # the last one is a separator, the smallest

        def key(rows: np.ndarray, k: int) -> np.ndarray:
            value = self.keys[at[rows] + k]
            left = np.clip(length[rows] - k, 0, PER_KEY)
            fill = (np.int64(1) << (BITS * (PER_KEY - left))) - 1
            return value | fill

        rows = np.arange(len(at))
        rank = ranks(key(rows, 0))[1]
        for k in range(PER_KEY, self.depth, PER_KEY):
            rows = rows[length[rows] >= k]
            if not len(rows):
                break
            more, old = key(rows, k), rank[rows]
            order = np.lexsort((more, old))
            old, more = old[order], more[order]
            group = np.concatenate([[True], old[1:] != old[:-1]])
            step = np.cumsum(~group & np.concatenate([[False], more[1:] != more[:-1]]))
            start = np.flatnonzero(group)
            step -= np.repeat(step[start], np.diff(np.append(start, len(old))))
            last = np.append(start[1:], len(old)) - 1
            widen = np.zeros(int(rank.max()) + 2, np.int64)
            widen[old[last] + 1] = step[last]
            rank += np.cumsum(widen)[rank]
            rank[rows[order]] += step
        return rank


class _Minima:
    """Smallest values of ranges of a block."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of values[low..high], both included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.uint8)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k)) + 1])
        return out


class _Scan:
    """One direction of the induction."""

    def __init__(self, text: _Text, queue: Queue):
        self.text, self.queue = text, queue
        self.since = np.zeros(SYMBOLS, np.uint8)  # smallest prefix since a symbol's last entry
        self.begun = np.zeros(SYMBOLS, bool)

    def pass_on(self, positions: np.ndarray, shared: np.ndarray, low: int, high: int) -> None:
        """Queue the suffixes before the scanned ones whose first symbol is in low..high."""
        if not len(positions):
            return
        before = self.text.symbols[positions - 1].astype(np.int32)  # of position 0: padding
        chosen = np.flatnonzero((positions > 0) & (before >= low) & (before <= high))
        order = np.argsort(before[chosen].astype(np.uint16), kind="stable")
        at = chosen[order]
        symbol = before[at]
        start = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(at) else at
        passed = self.since.copy()
        np.minimum(self.since, shared.min(), out=self.since)
        if not len(at):
            return
        minima = _Minima(shared)
        from_ = np.empty(len(at), np.int64)
        from_[1:] = at[:-1] + 1
        from_[start] = 0
        carried = minima(from_, at)
        first = symbol[start]
        carried[start] = np.minimum(carried[start], passed[first])
        new = np.minimum(carried.astype(np.int16) + 1, self.text.depth).astype(np.uint8)
        new[start[~self.begun[first]]] = 0
        ends = np.append(start[1:], len(at))
        found = (positions[at] - 1).astype(np.int32)
        for c, a, b in zip(first.tolist(), start.tolist(), ends.tolist()):
            self.queue.push(c, found[a:b], new[a:b])
        last = at[ends - 1]
        rest = np.full(len(first), self.text.depth, np.uint8)
        inner = np.flatnonzero(last < len(shared) - 1)
        if len(inner):
            rest[inner] = minima(last[inner] + 1, np.full(len(inner), len(shared) - 1))
        self.since[first] = rest
        self.begun[first] = True


def induced(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` symbols, and the prefix each shares with the one before.

    ``symbols`` has values 0 to 256 and ends in 0. Shared prefixes are cut at ``depth`` (250 at most).
    """
    text = _Text(symbols, depth)
    seeds = text.leftmost()
    if not len(seeds) or seeds[-1] != text.n - 1:
        seeds = np.append(seeds, text.n - 1)
    names = text.names(seeds)
    if len(names) and names.max() < len(names) - 1:
        order = suffix_array(names + 1, depth // 2 + 2)
    else:
        order = np.argsort(names)
    seeds = seeds[order].astype(np.int32)
    seed_shared = np.zeros(len(seeds), np.uint8)
    seed_shared[1:] = text.shared(seeds[:-1], seeds[1:])
    seed_at = np.searchsorted(text.symbols[seeds], np.arange(SYMBOLS + 1))

    def seam(a: np.ndarray, b: np.ndarray) -> int:
        return int(text.shared(a[-1:], b[:1])[0]) if len(a) and len(b) else 0

    queue = Queue()
    scan = _Scan(text, queue)
    large: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(SYMBOLS):
        large.append(_waves(scan, queue, c, c, SYMBOLS - 1))
        part = slice(seed_at[c], seed_at[c + 1])
        own, own_shared = seeds[part], seed_shared[part].copy()
        if len(own):
            own_shared[0] = seam(large[c][0], own)
            scan.pass_on(own, own_shared, c + 1, SYMBOLS - 1)
    queue.close()

    queue = Queue()
    scan = _Scan(text, queue)
    found, shared = [], []
    for c in reversed(range(SYMBOLS)):
        down, down_shared = _waves(scan, queue, c, 0, c)
        up, up_shared = large[c]
        back, back_shared = up[::-1], np.empty_like(up_shared)
        joint = seam(down, back)
        if len(up):
            back_shared[0] = joint
            back_shared[1:] = up_shared[:0:-1]
            scan.pass_on(back, back_shared, 0, c - 1)
        if c == 0:  # the last separator has no suffix behind it that would induce it
            down, down_shared = np.append(down, np.int32(text.n - 1)), np.append(down_shared, np.uint8(0))
            joint = 0
        rise, rise_shared = down[::-1], np.empty_like(down_shared)
        if len(down):
            rise_shared[0] = joint
            rise_shared[1:] = down_shared[:0:-1]
        found += [rise, up]
        shared += [rise_shared, up_shared]
    queue.close()
    return np.concatenate(found[::-1]), np.concatenate(shared[::-1])


def _waves(scan: _Scan, queue: Queue, c: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """All entries of symbol c; entries that they add for c itself follow as further blocks."""
    positions, shared = [], []
    while True:
        p, s = queue.take(c)
        if not len(p):
            break
        scan.pass_on(p, s, low, high)
        positions.append(p)
        shared.append(s)
    if not positions:
        return np.empty(0, np.int32), np.empty(0, np.uint8)
    return np.concatenate(positions), np.concatenate(shared)
