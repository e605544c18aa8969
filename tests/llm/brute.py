"""Plain versions of the operators, straight from their definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

BLANKS = r"[^\x20\x09-\x0D]+"
LOWER = {65 + i: 97 + i for i in range(26)}


def sha(value):
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def joined(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def secrets(text):
    text = text or ""
    assign = re.compile(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    found = [
        [m.span() for m in assign.finditer(text) if len(m[2]) >= 8],
        [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32],
    ]
    spans = [(a, k, b) for k, one in enumerate(found) for a, b in one]
    return (*map(len, found), sha(joined(spans, ["assign", "access", "hex"])))


def word_repeats(rows, width):
    """Kept words per row: windows that start in a document with a smaller id go."""
    split = [re.findall(BLANKS, t or "") for _, t in rows]
    rank = lambda i: (i is not None, i)
    first = {}
    for (i, _), words in zip(rows, split):
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for (i, _), words in zip(rows, split):
        gone = set()
        for k in range(len(words) - width + 1):
            if first[tuple(words[k : k + width])] < rank(i):
                gone |= set(range(k, k + width))
        kept = [w for k, w in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), sha(" ".join(kept))))
    return out


def byte_repeats(rows, width):
    """rows in order of their documents; equal rows are one document."""
    first = {}
    for n, (_, t) in enumerate(rows):
        data = (t or "").encode()
        for k in range(len(data) - width + 1):
            first.setdefault(data[k : k + width], (n, k))
    out = []
    for n, (i, t) in enumerate(rows):
        data = (t or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - width + 1):
            if first[data[k : k + width]] < (n, k):
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, sha(kept)))
    return out


def contamination(text, items, width=13):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: words.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, t in items:
        w = split(t)
        for k in [0] if 0 < len(w) < width else range(len(w) - width + 1):
            windows[tuple(w[k : k + width])].add(item)
    w = split(text)
    hit, found = set(), set()
    for size in {len(k) for k in windows}:
        for k in range(len(w) - size + 1):
            if (own := tuple(w[k : k + size])) in windows:
                hit |= set(range(k, k + size))
                found |= windows[own]
    ids = sorted("null" if i is None else str(i) for i in found)
    return len(w), len(hit), len(found), sha(",".join(ids)), 0 < len(hit) and 20 * len(hit) >= len(w)


def private(text):
    text = text or ""
    cards = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        twice = [d if n % 2 == 0 else sum(divmod(2 * d, 10)) for n, d in enumerate(digits[::-1])]
        if 14 <= len(digits) <= 19 and sum(twice) % 10 == 0:
            cards.append(m.span())
    found = [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [
            m.span()
            for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))
        ],
        cards,
        [
            m.span()
            for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15
        ],
    ]
    spans = [(a, k, b) for k, one in enumerate(found) for a, b in one]
    return (*map(len, found), sha(joined(spans, ["email", "ip", "card", "phone"])))


def simhash(text, width=4):
    words = re.findall(BLANKS, (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, radius):
    """Index of the smallest linked value for each value."""
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(values))]


def measures(text):
    text = text or ""
    words = re.findall(BLANKS, text)
    lines = [x for x in text.split("\n") if re.search(BLANKS, x)]
    places = defaultdict(list)
    for k in range(len(words) - 2):
        places[tuple(words[k : k + 3])].append(k)
    covered = {k + d for at in places.values() if len(at) > 1 for k in at for d in range(3)}
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def search(docs, items, k=10):
    """(item, rank, doc_id, score) from the whole score of every document."""
    terms = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: terms.findall((t or "").translate(LOWER))
    wanted = defaultdict(set)
    for item, t in items:
        wanted[item] |= set(split(t))
    words = [split(t) for _, t in docs]
    n_docs, total = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    counts = [Counter(w) for w in words]
    out = []
    for item, own in wanted.items():
        found = []
        for (i, _), w, tf in zip(docs, words, counts):
            m = 10 + 90 * len(w) * n_docs // total if w else 0
            score = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in own if t in tf)
            if score > 0:
                found.append((-score, i is not None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=_null_first)[:k], 1)]
    return out


def _null_first(row):
    return row[0], row[1], row[2] if row[1] else 0


def divergence(rows, min_docs=30, top=50):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = terms.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        n[lang, source].update(words)
        n[lang].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= min_docs]

        def shares(key):
            total = sum(n[key][t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (n[key][t] + 5) // total for t in kept}

        p, q = {s: shares((lang, s)) for s in sources}, shares(lang)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(q[t] - p[s][t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item, -v, r) for r, (v, item) in enumerate(found, 1)]
    return out


ALPHABETS = {
    "hex": ("[0-9a-f]+|[0-9A-F]+", "0123456789abcdef", 0.26),
    "base32": ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    "base62": ("[A-Za-z0-9]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.066),
    "base64": ("[A-Za-z0-9+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.066),
}


def battery(run):
    """(chi-squared, runs, serial correlation, distance from text), each as a z; None for digits only."""
    if re.fullmatch("[0-9]+", run):
        return None
    kind = next(k for k, (pattern, _, _) in ALPHABETS.items() if re.fullmatch(pattern, run))
    _, letters, share = ALPHABETS[kind]
    symbols = run.lower() if kind == "hex" else run.replace("-", "+").replace("_", "/")
    values, n, a = [letters.index(c) for c in symbols], len(run), len(letters)
    chi = a / n * sum(c * c for c in Counter(values).values()) - n
    df, middle = a - 1, (a - 1) / 2
    changes = sum((x < a / 2) != (y < a / 2) for x, y in zip(values, values[1:]))
    product = sum((x - middle) * (y - middle) for x, y in zip(values, values[1:]))
    spread = n * (a * share - 1)
    return (
        ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)),
        (changes - (n - 1) / 2) / math.sqrt((n - 1) / 4),
        product / ((a * a - 1) / 12) / math.sqrt(n - 1),
        (df + spread - chi) / math.sqrt(2 * (df + 2 * spread)),
    )


def secret_spans(texts, level=0.01):
    """Per text (start, end, kind) of all spans: patterns, and what the battery discovers in the whole table."""
    base, tested = [], []
    for text in texts:
        assign = re.finditer(
            r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text
        )
        spans = [(*m.span(), "assign") for m in assign if len(m[2]) >= 8]
        spans += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]{12,}", text)]
        spans += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]{32,}", text)]
        base.append(spans)
        runs = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{12,}", text):
            if (z := battery(m[0])) is not None:
                band = min(math.floor(2 * math.log2(len(m[0]))), 24)
                x = max(z[3], 0)
                # an upper bound of the normal tail, in tenths of its decimal logarithm
                tail = x * x / 2 / math.log(10) + math.log10((x + math.sqrt(x * x + 8 / math.pi)) / 2 * math.sqrt(2 * math.pi))
                place = min(max(math.floor(tail * 10), 0), 400)
                runs.append((*m.span(), band, place, z[0] < 3 and abs(z[1]) < 3 and abs(z[2]) < 3))
        tested.append(runs)
    limit = {}
    for band in {r[2] for runs in tested for r in runs}:
        own = [r for runs in tested for r in runs if r[2] == band]
        for place in sorted({r[3] for r in own}):
            found = sum(r[4] and r[3] >= place for r in own)
            if any(r[4] and r[3] == place for r in own) and len(own) * 10 ** (-place / 10) <= level * found:
                limit[band] = place
                break
    order = {"assign": 0, "access": 1, "hex": 2, "random": 3}
    out = []
    for spans, runs in zip(base, tested):
        new = [
            (a, b, "random")
            for a, b, band, place, random in runs
            if random and place >= limit.get(band, math.inf) and not any(x < b and a < y for x, y, _ in spans)
        ]
        out.append(sorted(spans + new, key=lambda s: (s[0], order[s[2]])))
    return out
