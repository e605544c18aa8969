"""Ranked lexical search against the whole score of every document."""

import random

import brute
import numpy as np
import pytest

from keybalance.llm import lexical_search

WORDS = ["alpha", "Beta", "gamma", "of", "OF", "of", "the", "x1", "été", "日本", "ß", "rare", "zz-top", "a_b"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def items_of(spark, given, kind="long"):
    schema = f"item_id {kind}, text string, doc_id long, term string, rank int, score string"
    return spark.createDataFrame([(i, t, 1, "x", 2, "s") for i, t in given], schema)


def random_texts(seed, n, longest=40):
    rnd = random.Random(seed)
    return [" ".join(rnd.choices(WORDS, k=rnd.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_equals_the_whole_scores(spark, documents, k, monkeypatch):
    monkeypatch.setattr(lexical_search, "FIRST_DEPTH", 2)
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 100)
    docs = list(enumerate(random_texts(1, 300)))
    items = list(enumerate(random_texts(2, 30, 8)))
    found = lexical_search.search(documents(docs), items_of(spark, items), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(found) == sorted(brute.search(docs, items, k), key=str)


def test_blocks_of_items_give_the_same(spark, documents):
    docs = list(enumerate(random_texts(3, 100)))
    items = list(enumerate(random_texts(4, 20, 8)))
    found = lexical_search.search(documents(docs), items_of(spark, items), block_bytes=300)
    assert rows(found) == sorted(brute.search(docs, items), key=str)


def test_ties_nulls_and_repeated_rows(spark, documents):
    docs = [(7, "one two"), (None, "one two"), (3, "one two"), (3, "one two"), (9, None), (None, None), (4, "")]
    items = [(1, "ONE"), (1, "two"), (2, None), (3, ""), (None, "two two"), (5, "absent"), (1, "ONE")]
    found = lexical_search.search(documents(docs), items_of(spark, items), k=3)
    assert rows(found) == sorted(brute.search(docs, items, 3), key=str)
    assert [r["doc_id"] for r in found.where("item_id = 1").orderBy("rank").collect()] == [None, 3, 3]


def test_empty_tables(spark, documents, no_rows):
    one = items_of(spark, [(1, "one")])
    assert rows(lexical_search.search(no_rows, one)) == []
    assert rows(lexical_search.search(documents([(1, "one")]), one.limit(0))) == []
    assert rows(lexical_search.search(documents([(1, None)]), one)) == []


def test_other_names_and_text_ids(spark, documents):
    docs = documents([(1, "one two"), (2, "two")], doc_id="term").withColumnRenamed("text", "a.b")
    items = items_of(spark, [("q", "two")], "string").withColumnRenamed("text", "n")
    found = lexical_search.search(docs, items, doc_id="term", doc_text="a.b", item_text="n")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in found.collect()] == [("q", 1, 2), ("q", 2, 1)]


def test_very_long_text(spark, documents, monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 1000)
    long = "needle " + "hay " * 400_000 + "needle"
    docs = [(1, long), (2, "needle"), (3, "hay")]
    items = [(1, "needle hay")]
    found = lexical_search.search(documents(docs), items_of(spark, items))
    assert rows(found) == sorted(brute.search(docs, items), key=str)


def test_session_setting_returns(spark, documents):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "7777")
    try:
        lexical_search.search(documents([(1, "one")]), items_of(spark, [(1, "one")]))
        assert spark.conf.get(name) == "7777"
    finally:
        spark.conf.unset(name)


def test_reading_stops_before_the_end():
    """Long lists are not read whole once no other document can reach the first ranks."""
    n = 100_000
    tf = np.ones(n + 1, np.int64)
    tf[:10] = 50
    postings = lexical_search.Postings(
        np.full(n + 1, 100), np.arange(n + 2), np.zeros(n + 1, np.int64), tf, np.array([1000]), n, 100 * n
    )
    read = []
    ranges = lexical_search._ranges

    def counted(start, end):
        read.append(int((end - start).sum()))
        return ranges(start, end)

    lexical_search._ranges, before = counted, ranges
    try:
        found, scores = postings.best(np.array([0]), 0, 10)
    finally:
        lexical_search._ranges = before
    assert sorted(found) == list(range(10)) and len(set(scores)) == 1
    assert sum(read) <= 64
