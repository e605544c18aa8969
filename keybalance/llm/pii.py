"""Personal data: fixed patterns, and a skip-chain conditional random field over each document.

The patterns give the base spans. The field then labels the tokens of a document that
could be personal data (those with a digit or an at sign): neighbours share chain
potentials, and distant tokens that repeat or resemble each other (equal letters and
digits, or one ending in seven or more digits of the other) share skip potentials.
Tokens of base spans are observed; loopy belief propagation carries their labels over
the skip edges to further mentions, so that one document labels an entity the same way
throughout: each mention is tied to the one before it and to an observed one, however far
away, and messages pass until they stop changing. A mention without any tie to a base span
adds nothing.

The weights are fitted on all documents, with the base spans as labels, by
pseudo-likelihood: each token's label given its features and its neighbours' labels.
That depends only on how often each pattern (features, label, labels around) occurs, so
tasks count patterns and the driver gets one row for each, whatever the number and length
of documents. The documents of each kind, and those without personal data, weigh equally
much in sum, so a kind that is rare in the table is fitted like a frequent one.

Defined results: a null or empty text has no spans; rows are judged one by one, so
repeated rows and null ids make no difference; extra columns are ignored; without any
labelled token in the whole table the field adds nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keybalance.llm import batches as B

KINDS = ["email", "ip", "card", "phone"]
#: Marginal from which a token is taken.
SURE = 0.9
#: Rounds of messages, beside one for each token: no path is longer than the tokens, and
#: messages that go round in loops fade within these.
ROUNDS = 64
#: Change of a message that is passed on.
STILL = 1e-6
#: Letters and digits that equal tokens need to be tied; short ones repeat by chance.
MIN_FORM = 6
#: Prior weight of agreement over a skip edge. Base labels miss the very mentions that
#: skip edges are for, so a table without ties that speak against it leaves it as it is.
SKIP_PRIOR = 6.0
#: Tokens apart at most for a chain edge.
NEAR = 3

# Possessive quantifiers and the looks behind keep every search linear in the text.
_LOCAL_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<![^ \t-\r])[^ \t-\r]++")


def _emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _LOCAL_AT.finditer(text):
        start, at = max(m.start(), end), m.end()
        if start < at - 1 and (d := _DOMAIN.match(text, at)):
            out.append((start, d.end()))
            end = d.end()
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the patterns' matches, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.groups()]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- the field

O, LABELS = 4, 5  # labels: the kinds, then none
FEATURES = 24


def _features(token: str) -> np.ndarray:
    """Indicators of a token's shape; none of them repeats a base pattern."""
    x = np.zeros(FEATURES)
    digits = sum(c.isdigit() for c in token)
    x[0] = 1
    x[1] = "@" in token
    x[2] = token.count(".") == 3
    x[3] = 0 < token.count(".") < 3
    x[4] = token[:1] in "+("
    x[5] = "-" in token
    x[6] = any(c.isalpha() for c in token)
    x[7] = digits == len(token)
    x[8 + min(digits, 9)] = 1
    x[18] = digits >= 13
    x[19] = digits >= 7
    x[20] = len(token) > 24
    x[21] = token[:1] == "("
    x[22] = "=" in token or ":" in token
    x[23] = "/" in token
    return x


@dataclass
class Graph:
    """Candidate tokens of one document: where they stand, features, observed labels, edges."""

    start: list[int]
    end: list[int]
    x: np.ndarray
    label: np.ndarray  # -1 where no base span says
    chain: np.ndarray  # pairs of tokens
    skip: np.ndarray


def _ties(tokens: list[str], label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of tokens with the same letters and digits, or the same last seven digits.

    Each token is tied to the one before it, and one that no base span holds to the observed
    one before it too, or else to the first behind it.
    """
    last: dict[str, int] = {}
    seen: dict[str, int] = {}
    waiting: dict[str, list[int]] = {}
    out = set()
    for i, t in enumerate(tokens):
        form = re.sub(r"[\W_]+", "", t).lower()
        digits = "".join(c for c in form if c.isdigit())
        keys = {form} if len(form) >= MIN_FORM else set()
        if len(digits) >= 7:
            keys.add("#" + digits[-7:])
        for k in keys:
            if k in last:
                out.add((last[k], i))
            if label[i] >= 0:
                out.update((j, i) for j in waiting.pop(k, ()))
                seen[k] = i
            elif k in seen:
                out.add((seen[k], i))
            else:
                waiting.setdefault(k, []).append(i)
            last[k] = i
    return sorted(out)


def graph(text: str, spans: list[tuple[int, int, int]]) -> Graph:
    start, end, words, place = [], [], [], []
    for n, m in enumerate(_TOKEN.finditer(text)):
        token = m.group()
        if "@" in token or _DIGITS.search(token):
            a, b = m.span()
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while b > a and not (text[b - 1].isalnum() or text[b - 1] == ")"):
                b -= 1
            if a < b:
                start.append(a)
                end.append(b)
                words.append(text[a:b])
                place.append(n)
    label = np.full(len(start), -1)
    for a, kind, b in spans:
        lo = int(np.searchsorted(end, a, "right"))
        while lo < len(start) and start[lo] < b:
            label[lo] = kind
            lo += 1
    chain = [(i, i + 1) for i in range(len(place) - 1) if place[i + 1] - place[i] <= NEAR]
    pair = lambda e: np.array(e, np.int64).reshape(-1, 2)
    x = np.array([_features(w) for w in words]).reshape(-1, FEATURES)
    return Graph(start, end, x, label, pair(chain), pair(_ties(words, label)))


@dataclass(frozen=True)
class Weights:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # agreement per label
    skip: np.ndarray


#: Bits of a pattern: features, counts of each label along chain and skip edges, label, kinds of the document.
_CHAIN_AT, _SKIP_AT, _LABEL_AT, _KINDS_AT = FEATURES, FEATURES + 3 * LABELS, FEATURES + 6 * LABELS, 57


def patterns(g: Graph) -> np.ndarray:
    """Features, label and labels around of each token as one number.

    Tokens that no base span holds but skip edges tie to one are left out, as tokens and as
    neighbours: they are what the field is to find, and no pattern says that they are nothing.
    """
    y = np.where(g.label >= 0, g.label, O)
    known = (g.label >= 0) | ~_supported(g)
    code = (g.x.astype(np.int64) << np.arange(FEATURES)).sum(axis=1) | (y << _LABEL_AT)
    for e, at in ((g.chain, _CHAIN_AT), (g.skip, _SKIP_AT)):
        e = e[known[e].all(axis=1)]
        # at most four such edges of a kind meet at a token: three bits hold a count
        np.add.at(code, e[:, 0], 1 << (at + 3 * y[e[:, 1]]))
        np.add.at(code, e[:, 1], 1 << (at + 3 * y[e[:, 0]]))
    return code[known]


def fit(graphs: list[Graph], **how) -> Weights | None:
    """Weights from graphs, each of which counts once."""
    code = np.concatenate([np.empty(0, np.int64), *[patterns(g) for g in graphs if len(g.start)]])
    return fit_patterns(*np.unique(code, return_counts=True), **how)


def fit_patterns(
    code: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-3
) -> Weights | None:
    """Weights by gradient ascent on the pseudo-likelihood of the labels in weighted patterns."""
    y = (code >> _LABEL_AT) & 7
    if not (y != O).any():
        return None
    x = ((code[:, None] >> np.arange(FEATURES)) & 1).astype(float)
    labels = 3 * np.arange(LABELS)
    around = [((code[:, None] >> (at + labels)) & 7).astype(float) for at in (_CHAIN_AT, _SKIP_AT)]
    hot = np.eye(LABELS)[y]
    share = (weight / weight.sum())[:, None]
    prior = [np.zeros(LABELS), np.full(LABELS, SKIP_PRIOR)]
    unary, pair = np.zeros((FEATURES, LABELS)), [p.copy() for p in prior]
    for _ in range(steps):
        score = x @ unary + sum(w * n for w, n in zip(pair, around))
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = (hot - p) * share
        unary += rate * (x.T @ miss - decay * unary)
        for w, n, mean in zip(pair, around, prior):
            # an edge never makes its ends disagree
            np.maximum(w + rate * ((n * miss).sum(axis=0) - decay * (w - mean)), 0, out=w)
    return Weights(unary, *pair)


def marginals(g: Graph, w: Weights, rounds: int | None = None) -> np.ndarray:
    """Label distribution of each token by loopy sum-product; observed tokens stay fixed.

    Runs until no message changes; a round sends only from tokens that messages have changed.
    """
    n = len(g.start)
    belief = g.x @ w.unary
    seen = g.label >= 0
    belief[seen] = -50.0
    belief[np.flatnonzero(seen), g.label[seen]] = 0.0
    edges = np.concatenate([g.chain, g.skip])
    gain = np.concatenate([np.tile(w.chain, (len(g.chain), 1)), np.tile(w.skip, (len(g.skip), 1))])
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    bonus = np.expm1(np.concatenate([gain, gain]))
    back = np.roll(np.arange(len(source)), len(edges))
    message = np.zeros((len(source), LABELS))
    heard = np.flatnonzero(~seen[target])
    by_source = heard[np.argsort(source[heard], kind="stable")]
    first = np.searchsorted(source[by_source], np.arange(n + 1))
    active = by_source
    for _ in range(n + ROUNDS if rounds is None else rounds):
        out = belief[source[active]] - message[back[active]]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        # potential: exp(gain) where labels agree, 1 elsewhere
        sent = np.log(out.sum(axis=1, keepdims=True) + bonus[active] * out)
        change = sent - sent.max(axis=1, keepdims=True) - message[active]
        moved = (np.abs(change) > STILL).any(axis=1)
        if not moved.any():
            break
        active, change = active[moved], change[moved]
        message[active] += change
        np.add.at(belief, target[active], change)
        new = np.unique(target[active])
        count = first[new + 1] - first[new]
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        active = by_source[np.repeat(first[new], count) + offset]
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _supported(g: Graph) -> np.ndarray:
    """Tokens that skip edges tie, over any number of steps, to an observed one."""
    root = list(range(len(g.start)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in g.skip.tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    held = {find(i) for i in np.flatnonzero(g.label >= 0).tolist()}
    return np.array([find(i) in held for i in range(len(root))], bool)


def added_spans(text: str, spans: list[tuple[int, int, int]], w: Weights | None) -> list[tuple[int, int, int]]:
    """Mentions that the field adds to the base spans of a document."""
    if not spans or w is None:
        return []
    g = graph(text, spans)
    open_ = _supported(g) & (g.label < 0)
    if not open_.any():
        return []
    p = marginals(g, w)
    out = []
    for i in np.flatnonzero(open_):
        kind = int(p[i, :O].argmax())
        if p[i, kind] >= SURE:
            out.append((g.start[i], kind, g.end[i]))
    return out


# ---------------------------------------------------------------- Spark


def train(docs: DataFrame, text: str = "text") -> Weights | None:
    """Weights from the patterns of all documents; none only if no document has a base span."""

    def count(parts):
        for batch in parts:
            found, kinds = [], []
            for t in batch.column("text"):
                t = t.as_py() or ""
                spans = base_spans(t)
                g = graph(t, spans)
                if len(g.start):
                    kinds.append(sum(1 << k for k in {k for _, k, _ in spans}))
                    found.append(patterns(g) | (kinds[-1] << _KINDS_AT))
            if found:
                # documents by their kinds stand below zero, patterns above
                code = np.concatenate([*found, -1 - np.array(kinds, np.int64)])
                code, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "code long, n long")
    counted = rows.groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()  # one row a pattern
    code, n = np.array([tuple(r) for r in counted], np.int64).reshape(-1, 2).T
    seen = {-1 - int(c): int(k) for c, k in zip(code, n) if c < 0}
    of_kind = [sum(k for m, k in seen.items() if m >> i & 1) for i in range(len(KINDS))]
    worth = np.zeros(1 << len(KINDS))
    for m in seen:
        worth[m] = max([1 / of_kind[i] for i in range(len(KINDS)) if m >> i & 1], default=1 / seen[m])
    code, n = code[code >= 0], n[code >= 0]
    return fit_patterns(code, n * worth[code >> _KINDS_AT])


RESULT = "base array<struct<start:long,kind:string,end:long>>, spans array<struct<start:long,kind:string,end:long>>"


def find(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: Weights | None = None
) -> DataFrame:
    """doc_id, base spans and all spans of every document, by start, then kind as listed."""
    B.bound_batches(docs.sparkSession)
    weights = weights or train(docs, text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    named = lambda spans: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans]

    def search(parts):
        for batch in parts:
            base, every = [], []
            for t in batch.column("text"):
                t = t.as_py() or ""
                found = base_spans(t)
                base.append(named(found))
                every.append(named(sorted(found + added_spans(t, found, weights))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(base, span), pa.array(every, span)],
                ["doc_id", "base", "spans"],
            )

    return slim.mapInArrow(search, f"doc_id {kind}, {RESULT}")


def digest(found: DataFrame) -> DataFrame:
    """Base counts by kind and span lists as text."""
    joined = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
