"""Secrets in texts: fixed patterns and a battery of randomness tests, native expressions only.

Fixed patterns give the base spans. Beyond them, every run of 12 or more characters
of the usual encodings is tested for looking like random symbols of its inferred
encoding (hex, base32, base62, base64):

- chi-squared distance of its symbol counts from the uniform distribution;
- runs of symbols from the lower and the upper half of the alphabet;
- lag-1 serial correlation of the symbol values.

A run must look random to all three. How surprising its uniformity is for ordinary
text follows from the distribution that the same statistic has when symbols are
drawn with the letter shares of text; this distribution moves away from uniform in
proportion to the length, so short runs cannot reach small p-values. The p-values of
all documents then go through Benjamini-Hochberg control within bands of
length. Its ranks come from a histogram of p-values (bands x bins, a fixed size), so
no candidate is collected or sorted.

Defined results: a null or empty text has no spans; repeated rows and null ids are
scanned like any other; extra columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keybalance.functions.keys import column_ref
from keybalance.llm.native import cut, free_name, let, matches, once, running, text_of
from keybalance.workdir import written

#: The base patterns in their order, and how many characters count.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex"]
ASSIGN_CHARS = 8

#: Symbols of a run that is tested. Of twelve that all differ, the best p-value is 0.002: such a run
#: is a discovery only if one in five runs of its length looks as random; of fewer, hardly ever.
RUN = r"[A-Za-z0-9+/_-]{12,}"
#: Alphabets in the order of their symbol values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Fixed value: sum of squared letter shares of European text, about the same in
#: English, French, German and Spanish; for the letters a-f alone it is higher.
TEXT_CONCENTRATION = {"hex": 0.26, "base32": 0.066, "base62": 0.066, "base64": 0.066}
MAX_Z = 3.0
FALSE_DISCOVERY = 0.01
BINS_PER_UNIT = 10
MAX_BIN = 400
MASK = "[SECRET]"
SPAN = "array<struct<start:int,end:int,kind:string>>"


def _as_kind(spans: Column, kind: str) -> Column:
    return F.transform(
        spans,
        lambda m: F.struct(m["start"], m["end"], F.lit(kind).alias("kind")),
    )


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans by start, then kind as listed."""
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["part"]) >= ASSIGN_CHARS)
    return _sorted(
        F.concat(
            _as_kind(assign, "assign"),
            _as_kind(matches(text, ACCESS), "access"),
            _as_kind(matches(text, HEX), "hex"),
        )
    )


def _sorted(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in [*KINDS, "random"]])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(kinds, s["kind"]).alias("k"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
        ),
    )
    return F.transform(
        F.sort_array(keyed),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )


def encoding(run: Column) -> Column:
    """The smallest alphabet that holds the run; null for digits only, which are numbers."""
    plain = F.replace(F.replace(run, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return (
        F.when(run.rlike(r"^[0-9]+$"), None)
        .when(run.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(run.rlike(r"^[A-Z2-7]+$"), "base32")
        .when(run.rlike(r"^[A-Za-z0-9]+$"), "base62")
        .when(plain.rlike(r"^[A-Za-z0-9+/]+$"), "base64")
    )


def battery(run: Column) -> Column:
    """struct(length, encoding, z_chi, z_runs, z_serial, z_text) of a run of symbols.

    The first three z are near 0 for random symbols; ``z_text`` is how far the
    uniformity lies below what text of this length has (large for random symbols).
    """
    sizes = F.create_map(*[x for k, a in ALPHABETS.items() for x in (F.lit(k), F.lit(len(a)))])
    shares = F.create_map(
        *[x for k, v in TEXT_CONCENTRATION.items() for x in (F.lit(k), F.lit(v))]
    )
    letters = F.create_map(*[x for k, a in ALPHABETS.items() for x in (F.lit(k), F.lit(a))])

    def of(kind: Column) -> Column:
        symbols = (
            F.when(kind == "hex", F.lower(run))
            .when(kind == "base64", F.translate(run, "-_", "+/"))
            .otherwise(run)
        )
        return let(symbols, lambda s: _tests(s, kind, sizes[kind], shares[kind], letters[kind]))

    return let(encoding(run), of)


def _tests(run: Column, kind: Column, size: Column, share: Column, letters: Column) -> Column:
    n = F.length(run).cast("double")
    a = size.cast("double")
    symbols = F.split(run, "")

    def of(values: Column) -> Column:
        counts = F.aggregate(
            F.array_distinct(values),
            F.lit(0.0),
            lambda t, v: t + F.pow(F.size(F.filter(values, lambda x: x == v)).cast("double"), F.lit(2.0)),
        )
        df = a - 1
        spread = n * (a * share - 1)
        pairs = F.zip_with(
            F.slice(values, 1, F.size(values) - 1),
            F.slice(values, 2, F.size(values) - 1),
            lambda x, y: F.struct(x.alias("x"), y.alias("y")),
        )
        runs = 1 + F.size(F.filter(pairs, lambda p: (p["x"] * 2 < size) != (p["y"] * 2 < size)))
        product = F.aggregate(
            pairs,
            F.lit(0.0),
            lambda t, p: t + (p["x"] - (a - 1) / 2) * (p["y"] - (a - 1) / 2),
        )
        return let(
            a / n * counts - n,
            lambda chi: F.struct(
                F.length(run).alias("length"),
                kind.alias("encoding"),
                (
                    (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
                ).alias("z_chi"),
                ((runs - 1 - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("z_runs"),
                (product / ((a * a - 1) / 12) / F.sqrt(n - 1)).alias("z_serial"),
                ((df + spread - chi) / F.sqrt(2 * (df + 2 * spread))).alias("z_text"),
            ),
        )

    return let(F.transform(symbols, lambda c: F.instr(letters, c) - 1), of)


def _passes(z: Column) -> Column:
    """The run looks random to every test of the battery."""
    return (
        z["encoding"].isNotNull()
        & (z["z_chi"] < MAX_Z)
        & (F.abs(z["z_runs"]) < MAX_Z)
        & (F.abs(z["z_serial"]) < MAX_Z)
    )


def band(length: Column) -> Column:
    """Bands of length: a new one at each power of the square root of two, 16 at most."""
    return F.least(F.floor(2 * F.log2(length.cast("double"))), F.lit(24)).cast("int")


def p_bin(z_text: Column) -> Column:
    """Tenths of -log10 of the upper normal tail; the tail is bounded from above."""
    x = F.greatest(z_text, F.lit(0.0))
    tail = (
        x * x / 2 * 0.4342944819032518
        + F.log10((x + F.sqrt(x * x + 2.546479)) / 2 * F.lit(2.5066282746))
    )
    return F.least(F.greatest(F.floor(tail * BINS_PER_UNIT), F.lit(0)), F.lit(MAX_BIN)).cast("int")


def candidates(text: Column) -> Column:
    """array<struct<start,end,band,bin,random>> of all runs that have an encoding."""
    tested = F.transform(
        matches(text, RUN),
        lambda m: let(
            battery(m["found"]),
            lambda z: F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                band(z["length"]).alias("band"),
                p_bin(z["z_text"]).alias("bin"),
                _passes(z).alias("random"),
                z["encoding"].isNotNull().alias("known"),
            ),
        ),
    )
    return F.filter(tested, lambda c: c["known"])


def thresholds(found: DataFrame, runs: str = "runs", level: float = FALSE_DISCOVERY) -> dict:
    """Per length band the smallest bin of p-values that is a discovery.

    Counts run over the candidates of all documents; the result has one row a band.
    """
    counts = (
        found.select(F.explode(runs).alias("c"))
        .groupBy(F.col("c.band").alias("band"), F.col("c.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c.random")).alias("hits"))
    )
    rows = {}
    for r in counts.collect():  # bands x bins rows at most
        rows.setdefault(r["band"], []).append((r["bin"], r["n"], r["hits"]))
    out = {}
    for b, bins in rows.items():
        total, rank = sum(n for _, n, _ in bins), 0
        for at, _, hits in sorted(bins, reverse=True):
            rank += hits
            if hits and total * 10 ** (-at / BINS_PER_UNIT) <= level * rank:
                out[b] = at
    return out


def discovered(runs: Column, base: Column, limits: dict) -> Column:
    """Spans of the runs beyond their band's threshold that no base span touches."""
    if not limits:
        return F.array().cast(SPAN)
    limit = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])
    chosen = F.filter(
        runs,
        lambda c: c["random"]
        & F.coalesce(c["bin"] >= limit[c["band"]], F.lit(False))
        & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return F.transform(
        chosen,
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), F.lit("random").alias("kind")
        ),
    )


def span_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (array of spans) and spans (base and randomness spans) of every row.

    What a text holds is found once and written to the shared folder (spans only);
    the thresholds are read from there.
    """
    body = text_of(text)
    found = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            once(F.struct(base_spans(body).alias("base"), candidates(body).alias("runs"))),
        ),
        "secret-runs",
    )
    limits = thresholds(found)
    return found.select(
        "doc_id",
        "base",
        once(
            F.struct(
                _sorted(
                    F.concat("base", discovered(F.col("runs"), F.col("base"), limits))
                ).alias("spans")
            )
        ),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind and span lists as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mask``; spans by start."""

    def by(upto: Column) -> Column:
        gaps = F.transform(
            spans,
            lambda s, i: F.struct(
                F.when(i == 0, F.lit(0)).otherwise(F.get(upto, i - 1)).alias("start"),
                s["start"].alias("end"),
                i.alias("i"),
            ),
        )
        apart = F.filter(gaps, lambda g: (g["i"] == 0) | (g["end"] >= g["start"]))
        kept = F.transform(cut(text, apart), lambda gap: F.concat(gap, F.lit(mask)))
        rest = F.substring(text, F.element_at(upto, -1) + 1, F.length(text))
        return F.concat(F.array_join(kept, ""), rest)

    ends = F.transform(spans, lambda s: s["end"])
    return F.when(F.size(spans) > 0, let(running(ends, F.greatest), by)).otherwise(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in their texts masked; a text without any stays as it is.

    ``n_chars``, where there is such a column, follows the text.
    """
    body = text_of(text)
    limits = thresholds(docs.select(once(F.struct(candidates(body).alias("runs")))))
    columns = docs.columns
    base, spans, new = (free_name(n, columns) for n in ("_base", "_spans", "_masked"))
    # one step after another: nested in one expression, the analyzer would give up on its depth
    every = _sorted(F.concat(base, discovered(candidates(body), F.col(base), limits)))
    hidden = F.when(F.size(spans) > 0, masked(body, F.col(spans)))
    out = (
        docs.select("*", once(F.struct(base_spans(body).alias(base))))
        .select("*", once(F.struct(every.alias(spans))))
        .select("*", once(F.struct(hidden.alias(new))))
    )
    hit = F.col(new).isNotNull()
    changed = {text: F.when(hit, F.col(new)).otherwise(column_ref(text))}
    if "n_chars" in columns and text != "n_chars":
        changed["n_chars"] = F.when(hit, F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[changed[c].alias(c) if c in changed else column_ref(c) for c in columns])
