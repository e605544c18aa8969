"""Inputs that are legal and unusual: long rows, structured words, clashing names."""

import datetime
import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from keybalance.llm import (
    batches,
    chat_format,
    decontaminate,
    native,
    pii,
    quality,
    secret_scan,
    simhash,
    substring_dedup,
    url_filter,
)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


# ---------------------------------------------------------------- words that polynomials confuse


def thue_morse(first, second, n):
    return "".join((first, second)[i.bit_count() & 1] for i in range(n))


def test_words_of_equal_polynomials_are_told_apart(documents):
    a, b = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}")]
    found = substring_dedup.digest(substring_dedup.remove_repeats(documents(rows)))
    assert sorted(map(tuple, found.collect())) == sorted(brute.word_repeats(rows, 50))


def test_test_words_of_equal_polynomials_are_told_apart(spark, documents):
    a, b = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)
    rest = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(1, f"{a} {rest}")], "item_id long, text string")
    found = decontaminate.contamination(documents([(1, f"{b} {rest}"), (2, f"{a} {rest}")]), items)
    assert {r["doc_id"]: r["n_hit"] for r in found.collect()} == {1: 0, 2: 13}


def test_word_hashes_are_kept_in_bounds(monkeypatch):
    held = batches._WordHashes()
    monkeypatch.setattr(held, "MOST", 10, raising=False)
    words = [b"%d" % i for i in range(100)] + [b"x" * 1000]
    assert [held[w] for w in words] == [held[w] for w in words]
    assert len(held) <= 10


# ---------------------------------------------------------------- personal data


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.2.3", "1.2." + "0" * 9000 + "7.255", "0" * 4400 + "9.1.1.256"])
def test_parts_of_many_zeros(documents, text):
    row = pii.digest(pii.find(documents([(1, text)]))).first()
    assert (row["n_ip"], row["base_sha256"]) == (
        int(not text.endswith("256")),
        brute.sha(f"ip:0:{len(text)}" if not text.endswith("256") else ""),
    )


# ---------------------------------------------------------------- long rows


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000])
def test_running_results(spark, n):
    rnd = random.Random(n)
    values = [rnd.randint(-5, 9) for _ in range(n)]
    got = one(spark, native.running(F.col("v")), v=values)
    assert got == [sum(values[: i + 1]) for i in range(n)]
    got = one(spark, native.running(F.col("v"), F.greatest), v=values)
    assert got == [max(values[: i + 1]) for i in range(n)]


def test_cutting_a_text(spark):
    text = "aé日😀" * 50
    spans = [(i, i + i % 4) for i in range(0, 200, 4)]
    column = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans])
    assert one(spark, native.cut(F.col("t"), column), t=text) == [text[a:b] for a, b in spans]
    assert one(spark, native.cut(F.col("t"), F.array().cast("array<struct<start:int,end:int>>")), t=text) == []


def test_many_matches_in_one_text(documents):
    text = " ".join(f"token=abcd.fgh{i:05d}" for i in range(64_000))
    text += " " + " ".join(f"of-sixteen-{i:05d}" for i in range(2000))  # these are tested for randomness
    start = time.perf_counter()
    row = secret_scan.digest(secret_scan.scan(documents([(1, text)]))).first()
    assert tuple(row)[1:5] == brute.secrets(text)
    assert time.perf_counter() - start < 60


def test_masking_overlaps_and_neighbours(spark):
    spans = [(0, 3), (2, 5), (5, 6), (8, 9), (8, 12)]
    column = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans])
    assert one(spark, secret_scan.masked(F.col("t"), column, "#"), t="0123456789abcdef") == "##67#cdef"


def test_many_turns_in_one_conversation(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f"é text {i}") for i in range(64_000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    start = time.perf_counter()
    row = chat_format.digest(chat_format.format_chats(frame)).first()
    assert row["n_turns"] == len(turns)
    assert row["loss_sha256"] == brute.sha("".join(t for _, _, r, t in turns if r == "assistant"))
    assert row["turns_sha256"] == brute.sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns))
    assert time.perf_counter() - start < 60


# ---------------------------------------------------------------- names


def test_stages_keep_columns_of_any_name(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, 1, "a", 5), (2, text, 2, "b", 6), (3, "password=abcdefgh12345 " + text, 3, "c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, rejected_by string, _MASKED int")
    assert quality.keep_good(docs).columns == docs.columns
    assert sorted(map(tuple, quality.keep_good(docs).collect())) == rows
    assert quality.judge(docs).columns == [*docs.columns, "rejected_by_"]
    masked = secret_scan.redact(docs)
    assert masked.columns == docs.columns
    assert [r["text"][:8] for r in masked.orderBy("doc_id").collect()] == ["word0 wo", "word0 wo", "[SECRET]"]
    items = spark.createDataFrame([(1, "no such words")], "item_id long, text string")
    assert decontaminate.remove_contaminated(docs, items).columns == docs.columns
    kept = simhash.drop_near_duplicates(docs, radius=0)
    assert kept.columns == docs.columns and kept.count() == 2


def test_captures_keep_columns_of_any_name(spark):
    day = datetime.date(2024, 1, 5)
    captures = spark.createDataFrame(
        [("http://a.com/", day, "k", "own", "h", "f", 1)],
        "url string, fetched date, _key string, blocked_by string, _host string, _fetched string, `a.b` int",
    )
    entries = spark.createDataFrame([("ads", "a.com", day, "add")], "list string, key string, at date, action string")
    out = url_filter.filter_captures(captures, entries)
    assert out.columns == [*captures.columns, "blocked_by_"]
    assert tuple(out.first()) == ("http://a.com/", day, "k", "own", "h", "f", 1, ["ads:a.com"])


def test_lists_are_data_not_expressions(spark):
    """Many lists: the plan stays as it is."""
    day = datetime.date(2024, 1, 5)
    entries = [(f"list{i}", "a.com", day, "add") for i in range(400)]
    listed = spark.createDataFrame(entries, "list string, key string, at date, action string")
    captures = spark.createDataFrame([("http://x.a.com/", day)], "url string, fetched date")
    found = url_filter.filter_captures(captures, listed).first()["blocked_by"]
    assert found == sorted(f"list{i}:a.com" for i in range(400))
