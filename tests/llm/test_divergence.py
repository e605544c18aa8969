"""Source divergence against plain counting."""

import random

import brute
import numpy as np
import pytest

from keybalance.llm import divergence

WORDS = [
    "a", "The", "é", "日本語", "exactly8", "ninebytes", "sixteenletterss", "abcdefghijklmnop",
    "abcdefghijklmnopq", "ü" * 9, "z" * 40, "Z" * 40 + "y", "x" * 700, "w" * 1500, "w" * 1500 + "v", "x1y",
]


def frame(spark, rows):
    schema = "text string, lang string, source string, doc_id long, term string, n int, docs string, p string"
    return spark.createDataFrame([(*r, None, "t", 1, "d", "p") for r in rows], schema)


def rows_of(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def some_rows(seed, n, langs=("en", "de", None), sources=7):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        s = rnd.randrange(sources)
        text = " ".join(rnd.choices(WORDS, [1 + (i * s) % 5 for i in range(len(WORDS))], k=rnd.randint(0, 30)))
        out.append((text, rnd.choice(langs), f"s{s}"))
    return out


@pytest.mark.parametrize("min_docs, top", [(30, 50), (3, 2), (10_000, 50)])
def test_equals_plain_counting(spark, min_docs, top):
    rows = some_rows(min_docs, 250)
    found = divergence.audit(frame(spark, rows), min_docs, top)
    assert rows_of(found) == sorted(brute.divergence(rows, min_docs, top))


def test_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 3)
    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    rows = some_rows(5, 300, ("en", "de"))
    assert rows_of(divergence.audit(frame(spark, rows), 5)) == sorted(brute.divergence(rows, 5))


def test_nulls_empty_and_repeated_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("word", "en", None), ("word", "en", "")] + [("word x", "en", "b")] * 3
    rows += [("only here", "fr", "one")] * 2
    for min_docs in (1, 3):
        assert rows_of(divergence.audit(frame(spark, rows), min_docs)) == sorted(brute.divergence(rows, min_docs))
    assert rows_of(divergence.audit(frame(spark, []))) == []


def test_clashing_names(spark):
    rows = some_rows(9, 60)
    renamed = frame(spark, rows).withColumnsRenamed({"text": "a.b", "term": "text", "source": "in lang", "n": "source"})
    found = divergence.audit(renamed, 3, text="a.b", source="in lang")
    assert rows_of(found) == sorted(brute.divergence(rows, 3))


def test_very_long_text_is_one_document(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_BYTES", 10_000)
    rnd = random.Random(3)
    long = " ".join(rnd.choices(WORDS, k=5_000)) + "q" * 30_000 + " " + " ".join(rnd.choices(WORDS, k=500))
    rows = [(long, "en", "a"), ("a the", "en", "b"), ("q" * 30_000, "en", "b"), (long, "en", "b")]
    for min_docs in (1, 2, 3):
        assert rows_of(divergence.audit(frame(spark, rows), min_docs)) == sorted(brute.divergence(rows, min_docs))


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 8_999_999_999_983, 1_999_999_999_999_999, 10**12
    row = spark.range(1).select(*[
        divergence.F.lit(v).cast("bigint").alias(c) for c, v in (("n", n), ("total", total), ("terms", terms))
    ])
    got = row.select(divergence.share(*[divergence.F.col(c) for c in ("n", "total", "terms")])).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_radix_order_is_stable():
    random_ = np.random.default_rng(1)
    words = [random_.integers(0, 4, 1000).astype(np.uint64) << np.uint64(60), random_.integers(0, 1 << 40, 1000).astype(np.uint64) % np.uint64(7)]
    order = divergence.radix_order(words)
    assert order.tolist() == sorted(range(1000), key=lambda i: (words[0][i], words[1][i]))
