"""Quality rules as a short-circuit cascade, in column expressions only.

Each rule is a predicate that rejects a text. Its cost and its selectivity are
estimated on a sample, and the cascade tries the rules in the order of rejected
rows per second: an expensive rule is computed only for the rows that the cheap
ones let through. The order never changes the verdict, only its price and which
rule is named.

Defined results: a null text counts as empty, and an empty text fails ``few_words``;
a null threshold result counts as passed. Rows are judged one by one, so repeated
rows, null ids and extra columns make no difference.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from keybalance.functions.keys import column_ref
from keybalance.llm.native import BLANKS, free_name, let, once, text_of, words_of

SYMBOLS = "[#*$%&|<>]"
#: Fixed limits of the rules, in percent where they are shares.
MIN_WORDS = 50
MAX_REPEATED = 50
MAX_SYMBOLS = 10
MAX_SAME_LINES = 60
MIN_ALPHABETIC = 80
MIN_MEAN, MAX_MEAN = 2, 15
MAX_BULLETS = 90
MAX_ELLIPSES = 30
SAMPLE_ROWS = 2000
_LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])"


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Windows are compared by 64-bit hash. Most texts repeat none, which the number
    of distinct hashes tells; only the others sort their windows.
    """

    def hashed(w: Column) -> Column:
        count = F.greatest(F.size(w) - (width - 1), F.lit(0))
        return F.transform(
            F.slice(w, 1, count), lambda x, i: F.xxhash64(x, *[w[i + k] for k in range(1, width)])
        )

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )

        def repeated(s: Column) -> Column:
            n = F.size(s)
            near = F.zip_with(
                F.slice(s, 1, n - 1),
                F.slice(s, 2, n - 1),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
            )
            starts = F.sort_array(
                F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull())))
            )
            # each window adds the words up to the next repeated window, itself at most
            return let(
                starts,
                lambda t: F.aggregate(
                    F.zip_with(
                        F.slice(t, 1, F.size(t) - 1),
                        F.slice(t, 2, F.size(t) - 1),
                        lambda a, b: F.least(b - a, F.lit(width)),
                    ),
                    F.lit(width).cast("long"),
                    lambda total, x: total + x,
                ),
            )

        return let(pairs, repeated)

    return let(
        words,
        lambda w: let(
            hashed(w),
            lambda h: F.when(
                F.size(h) > F.size(F.array_distinct(h)), covered(h)
            ).otherwise(F.lit(0).cast("long")),
        ),
    )


@dataclass(frozen=True)
class Parts:
    """A text with its words, which a rule computes only if nobody has before."""

    text: Column
    words: Column | None = None

    def with_words(self, use: Callable[[Column], Column]) -> Column:
        return use(self.words) if self.words is not None else let(words_of(self.text), use)


@dataclass(frozen=True)
class Rule:
    """``rejects(parts)`` is true for a text that the rule turns away."""

    name: str
    rejects: Callable[[Parts], Column]


def _share(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def _few_words(p: Parts) -> Column:
    return p.with_words(lambda w: F.size(w) < MIN_WORDS)


def _repeated(p: Parts) -> Column:
    return p.with_words(lambda w: _share(n_repeat_words(w), F.size(w), MAX_REPEATED))


def _symbols(p: Parts) -> Column:
    return p.with_words(lambda w: _share(n_symbols(p.text), F.size(w), MAX_SYMBOLS))


def _same_lines(p: Parts) -> Column:
    return let(worded_lines(p.text), lambda x: _share(n_dup_lines(x), F.size(x), MAX_SAME_LINES))


def _unalphabetic(p: Parts) -> Column:
    """Too many words without any letter."""
    plain = F.regexp_count(p.text, F.lit(_LETTERLESS))
    return p.with_words(lambda w: _share(plain, F.size(w), 100 - MIN_ALPHABETIC))


def _mean_length(p: Parts) -> Column:
    return p.with_words(
        lambda w: let(
            word_chars(w), lambda c: (c < F.size(w) * MIN_MEAN) | (c > F.size(w) * MAX_MEAN)
        )
    )


def _line_share(pattern: str, percent: int) -> Callable[[Parts], Column]:
    return lambda p: let(
        worded_lines(p.text),
        lambda x: _share(F.size(F.filter(x, lambda y: y.rlike(pattern))), F.size(x), percent),
    )


BASE_RULES = [Rule("few_words", _few_words), Rule("repeated_windows", _repeated)]
RULES = [
    *BASE_RULES,
    Rule("symbols", _symbols),
    Rule("same_lines", _same_lines),
    Rule("unalphabetic", _unalphabetic),
    Rule("mean_length", _mean_length),
    Rule("bullets", _line_share(r"^\s*(?:[-*+]\s|\x{2022})", MAX_BULLETS)),
    Rule("ellipses", _line_share(r"(?:\.\.\.|\x{2026})\s*$", MAX_ELLIPSES)),
]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def estimate(
    docs: DataFrame, rules: list[Rule], text: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7
) -> list[Estimate]:
    """Share of rejected rows and seconds of each rule over about ``rows`` sampled rows.

    The sample is bounded by the parameter and serves the order only. It is held for
    the length of the measurement; a lost executor makes it be drawn again.
    """
    total = docs.count()
    if not total:
        return [Estimate(r, 0.0, 1.0) for r in rules]
    body = text_of(text)
    sample = docs.select(body.alias("body")).sample(min(1.0, rows / total), seed).persist()
    try:
        size = max(sample.count(), 1)
        started = time.perf_counter()
        sample.agg(F.count_if(F.length("body") < 0)).first()
        idle = time.perf_counter() - started
        out = []
        for rule in rules:
            started = time.perf_counter()
            hits = sample.agg(F.count_if(rule.rejects(Parts(F.col("body")))).alias("n")).first()["n"]
            out.append(Estimate(rule, hits / size, time.perf_counter() - started - idle))
        return out
    finally:
        sample.unpersist()


def ordered(estimates: list[Estimate]) -> list[Rule]:
    """Rules by rejection per second, highest first; ties keep the given order."""
    return [e.rule for e in sorted(estimates, key=lambda e: -e.rank)]


def first_rejecting(rules: list[Rule], parts: Parts) -> Column:
    """Name of the first rule that rejects, null if none; later rules are not computed."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(parts), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(
    docs: DataFrame,
    text: str = "text",
    rules: list[Rule] | None = None,
    order: list[Rule] | None = None,
    verdict: str = "rejected_by",
) -> DataFrame:
    """``docs`` with the name of the rejecting rule, null for what is kept, as the last column.

    A column of that name stays; the verdict's then ends in an underscore more.
    """
    rules = rules or RULES
    order = order or ordered(estimate(docs, rules, text))
    body = text_of(text)
    # almost every text needs its words, so they are split once
    by = let(words_of(body), lambda w: first_rejecting(order, Parts(body, w)))
    verdict = free_name(verdict, docs.columns)
    return docs.select("*", once(F.struct(by.alias(verdict))))


def keep_good(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``."""
    judged = judge(docs, text, rules)
    rejected = column_ref(judged.columns[-1])
    return judged.where(rejected.isNull()).select(*[column_ref(c) for c in docs.columns])


def measures(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: list[Rule] | None = None
) -> DataFrame:
    """Base measures and the verdict of every row; the cascade runs only for rows that pass the base."""
    extra = [r for r in RULES if r not in BASE_RULES]
    order = order or ordered(estimate(docs, extra, text))
    body = text_of(text)

    def row(w: Column) -> Column:
        return let(
            F.struct(
                F.size(w).cast("long").alias("n_words"),
                word_chars(w).alias("word_chars"),
                n_symbols(body).alias("n_symbols"),
                n_dup_lines(worded_lines(body)).alias("n_dup_lines"),
                n_repeat_words(w).alias("n_repeat_words"),
            ),
            lambda m: let(
                (m["n_words"] < MIN_WORDS)
                | _share(m["n_repeat_words"], m["n_words"], MAX_REPEATED),
                lambda failed: let(
                    F.when(failed, F.lit("base")).otherwise(first_rejecting(order, Parts(body, w))),
                    lambda by: F.struct(
                        *[
                            m[c].alias(c)
                            for c in (
                                "n_words",
                                "word_chars",
                                "n_symbols",
                                "n_dup_lines",
                                "n_repeat_words",
                            )
                        ],
                        failed.alias("base_failed"),
                        by.isNull().alias("kept"),
                    ),
                ),
            ),
        )

    return docs.select(column_ref(doc_id).alias("doc_id"), once(let(words_of(body), row)))
