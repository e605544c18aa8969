"""Chats, packing, URL filters and the pipeline against plain versions."""

import datetime
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from keybalance.llm import chat_format, packing, quality, simhash, url_filter
from keybalance.llm.queries import tokenizer_path

PIECES = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "\\n", "\n", "<|im_end|>", "<|im_next|>", "<<SYS>>", "é\U0001f600", " x ", "<", "[", "|"]


def chats(seed):
    rng = random.Random(seed)
    some = lambda: "".join(rng.choices(PIECES, k=rng.randint(0, 6)))
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 8)):
            role = rng.choice(["user", "assistant", "system", "odd\nrole\\n", None, "assistant"])
            rows.append((conv, rng.choice([turn, turn // 2, None]), role, rng.choice([some(), None])))
    return rows + rows[:5] + [(None, 1, "user", "a"), (None, 2, "assistant", "b")]


@pytest.mark.parametrize("seed", range(3))
def test_chats_come_back(spark, seed):
    rows = chats(seed)
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, turns int, formatted string")
    out = chat_format.format_chats(frame)
    have = {r.conv_id: r for r in chat_format.digest(out).collect()}
    strings = {r.conv_id: r for r in out.collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(
            [(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv]
        )
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert have[conv].n_turns == len(turns)
        assert have[conv].turns_sha256 == brute.sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns))
        assert (have[conv].loss_chars, have[conv].loss_sha256) == (len(loss), brute.sha(loss))
        formatted = strings[conv].formatted
        assert have[conv].formatted_chars == len(formatted)
        merged = 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
        assert formatted.count(chat_format.OPEN) == formatted.count(chat_format.CLOSE) == merged
        assert not any(c in formatted for c in ("</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_no_chats(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chats(empty).count() == 0


WORDS = ["It's", "naïve", "\U0001f600", "x1y22", "don't", "<|endoftext|>", "ÀÉ", "...", "a", "snow-white", " b", "é"]


def pieces_of(spark, documents, rows, length=64):
    return packing.pack(documents(rows).repartition(4), tokenizer_path(), length=length).collect()


def test_word_ids_are_the_tokenizers(sf_dir):
    """Every word of real and odd texts, with a memory that overflows."""
    import duckdb
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' LIMIT 300").fetchall()]
    texts += ["\u00ab\u00c9t\u00e9\u00bb, '' don't'. x's', \u0130\u03a3 \u03c3\u03a3. \u00aa\u00ba\u00b5 a\u0301, \u00d7\u00f7 1,2.3", "<|endoftext|>, <|ENDOFTEXT|>.", "\u2003wide\u2003space\u00a0x"]
    for limit in (1 << 19, 50):
        words = packing.WordIds(tokenizer_path(), limit)
        assert words.by_piece
        for k in range(0, len(texts), 40):
            ids, bounds = words([t.encode() for t in texts[k : k + 40]])
            for t, a, b in zip(texts[k : k + 40], bounds, bounds[1:]):
                assert ids[a:b].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_words_are_looked_up_once_a_shard():
    """Distinct words only, odd blanks and bytes included; pieces outlast the words."""
    from tokenizers import Tokenizer

    class Counted(packing._Numbers):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    tokenizer = Tokenizer.from_file(tokenizer_path())
    words = packing.WordIds(tokenizer_path(), 5)
    words.known = Counted(words.known)
    texts = ["", " ", " red  blue\t\n", "\x0bred\x1cblue\x0c café x", "red, blue. red, blue", *["red blue"] * 200]
    for _ in range(2):
        ids, bounds = words([t.encode() for t in texts])
        for t, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert {"red", "blue"} <= set(words.pieces)
    assert 0 < Counted.asked < 20
    kept = dict(words.pieces)
    words._forget()
    assert words.pieces == kept
    ids, bounds = words([b"\xff\xfe red", b"red"])
    assert ids[bounds[1] :].tolist() == [*tokenizer.encode("red", add_special_tokens=False).ids, 1]


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = [(i, " \n ".join(rng.choices(WORDS, k=rng.choice([0, 1, 10, 200])))) for i in range(40)]
    rows += [(50, None), (None, "a"), (3, rows[3][1])]
    pieces = pieces_of(spark, documents, rows)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = sorted(
        np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in rows
    )
    place = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in place:  # gapless in sequences of full length
        assert r.sequence_id * 64 + r.offset == at and len(r.ids) == 4 * r.length > 0
        assert r.offset + r.length <= 64
        at += r.length
    whole, now = [], b""
    for r in place:
        assert r.start * 4 == len(now)
        now += bytes(r.ids)
        if r.start + r.length == r.doc_tokens:
            whole.append(now)
            now = b""
    assert not now and sorted(whole) == expected


def test_packing_edges(spark, documents, edges, no_rows):
    assert packing.pack(no_rows, tokenizer_path()).count() == 0
    rows = packing.digest(packing.pack(edges, tokenizer_path())).collect()
    assert len(rows) == edges.count() and {r.sequence_id for r in rows} == {0}
    empty = [r for r in rows if r.doc_id == 2][0]
    assert (empty.doc_tokens, empty.ids_crc32) == (1, zlib.crc32(np.array([1], "<u4").tobytes()))


DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


def captured(seed):
    rng = random.Random(seed)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "hot.net", "A.COM.", "localhost"]
    rows = []
    for i in range(300):
        host = "hot.net" if i % 3 == 0 else rng.choice(hosts)
        url = rng.choice([f"http://u:p@{host}:80/p?q=http://b.org/", f"HTTPS://{host}#x", f"http://{host}"])
        rows.append((i, url, rng.choice([day(rng.randint(0, 30)), None]) if i % 9 == 0 else day(rng.randint(0, 30))))
    entries = [
        (rng.choice(["ads", "bad"]), rng.choice(["a.com", "x.a.com", "hot.net", "b.org", "com"]), day(rng.randint(0, 30)), rng.choice(["add", "remove", "add"]))
        for _ in range(60)
    ]
    entries += [(None, "a.com", day(1), "add"), ("ads", None, day(1), "add"), ("ads", "a.com", None, "add")]
    return rows + [(900, None, day(3)), (901, "not a url", day(3)), (902, "", day(3))] + rows[:4], entries


def in_force(host, when, entries):
    labels = host.split(".")
    keys = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
    out = set()
    for name in ("ads", "bad"):
        for key in keys:
            past = [(at, what) for n, k, at, what in entries if (n, k) == (name, key) and at and at <= when]
            if past:
                last = max(at for at, _ in past)
                if all(what == "add" for at, what in past if at == last):
                    out.add(f"{name}:{key}")
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("share", [400, 5])
def test_list_entries_as_of_the_fetch(spark, seed, share, monkeypatch):
    import re

    monkeypatch.setattr(url_filter, "SLOT_SHARE", share)
    rows, entries = captured(seed)
    captures = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, fetched date, key string, slot int")
    listed = spark.createDataFrame(entries, "list string, key string, at date, action string")
    out = url_filter.filter_captures(captures, listed)
    got = sorted((r.page_id, tuple(r.blocked_by)) for r in out.collect())
    expected = []
    for i, url, when in rows:
        m = re.match(r"[a-zA-Z]+://(?:[^/@]*@)?([^/:#?]+)", url or "")
        host = m and m[1].lower().rstrip(".")
        expected.append((i, tuple(in_force(host, when, entries)) if host and when else ()))
    assert got == sorted(expected)
    assert [c for c in out.columns if c != "blocked_by"] == captures.columns


def test_no_captures_or_entries(spark):
    captures = spark.createDataFrame([], "url string, fetched date")
    none = spark.createDataFrame([], "list string, key string, at date, action string")
    assert url_filter.filter_captures(captures, none).count() == 0
    one = spark.createDataFrame([("http://a.com/", DAY)], "url string, fetched date")
    assert url_filter.filter_captures(one, none).first().blocked_by == []
    assert url_filter.filter_captures(captures, spark.createDataFrame([("l", "a.com", DAY, "add")], none.schema)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    """Each stage on the stage before: rejected, duplicate and contaminated documents go, others stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, sf_dir)
    kept = {r.doc_id for r in good.collect()}
    assert kept == {r.doc_id for r in quality.measures(docs).where("kept").collect()}
    rest = stages["near_duplicates"](spark, good, sf_dir)
    order = sorted(kept)
    values = [brute.simhash(texts[i]) for i in order]
    single = {order[k] for k in brute.linked(values, 4)}
    assert {r.doc_id for r in rest.collect()} == single
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, rest, sf_dir)
    pure = {i for i in single if not brute.contamination(texts[i], items)[-1]}
    assert {r.doc_id for r in clean.collect()} == pure
    masked = stages["secret_scans"](spark, clean, sf_dir)
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert (r.text == texts[r.doc_id]) == (brute.secrets(texts[r.doc_id])[:3] == (0, 0, 0))
        assert brute.secrets(r.text)[:3] == (0, 0, 0)
    pieces = stages["packing"](spark, masked, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == pure


def test_every_operator_is_registered():
    names = entry_point.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
