"""Substring dedup by words and by bytes against their definitions."""

import random

import brute
import numpy as np
import pytest

from keybalance.llm import occurrences, substring_dedup, suffix_dedup, suffixes


def texts(seed, n=60):
    """Documents that share passages, repeat themselves and copy each other."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cde", "f", "ghé", "ijkl", "mn"])
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 15)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), word() * rng.randint(0, 5)]
        out.append(" ".join(parts))
        if rng.random() < 0.2:
            out[-1] = rng.choice(out)
    return [(i * 3 % (n * 3), t) for i, t in enumerate(out)] + [(1, "ab " * 50), (2, "")]


@pytest.mark.parametrize("seed", range(3))
def test_word_windows(documents, seed):
    rows = texts(seed)
    got = substring_dedup.remove_repeats(documents(rows).repartition(5), width=6).collect()
    have = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert have == sorted(brute.word_repeats(rows, 6))
    for r in got:
        assert brute.sha(r.kept_text) == r.kept_sha256
        assert sum(x.end - x.start for x in r.intervals) == r.n_removed


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("split", [1, 4096])
def test_byte_strings(documents, seed, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    rows = sorted(texts(seed))
    found = suffix_dedup.remove_repeats(
        documents(rows).repartition(5), width=20, gram=8, split=split, sort_bytes=400
    ).collect()
    have = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert have == sorted(brute.byte_repeats(rows, 20))
    for r in found:
        assert brute.sha(bytes(r.kept)) == r.kept_sha256


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_one_group_at_a_time(documents, operator, monkeypatch):
    """Batches, groups and hash ranges of any size give the same rows."""
    rows = texts(5)
    options = {"gram": 8} if operator is suffix_dedup else {}
    whole, spread = (
        operator.remove_repeats(frame, width=20, **options).drop("intervals").collect()
        for frame in (documents(rows).coalesce(1), documents(rows).repartition(17))
    )
    assert sorted(map(str, whole)) == sorted(map(str, spread))
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(documents(rows), width=20, gram=32)


def test_word_edges(edges, no_rows):
    got = substring_dedup.remove_repeats(edges, width=3).collect()
    assert len(got) == edges.count()
    have = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got)
    assert have.count(("4", 3, 3)) == 2  # both copies repeat the row with the null id
    assert ("None", 3, 0) in have and ("5", 3, 0) in have and ("1", 0, 0) in have
    assert substring_dedup.remove_repeats(no_rows).count() == 0


def test_byte_edges(edges, no_rows):
    got = suffix_dedup.remove_repeats(edges, width=9, gram=4).collect()
    assert len(got) == edges.count()
    have = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got)
    assert have.count(("4", 13, 13)) == 2 and ("None", 13, 0) in have and ("1", 0, 0) in have
    assert suffix_dedup.remove_repeats(no_rows).count() == 0


def test_equal_rows_do_not_remove_each_other(documents):
    text = "a quick brown fox jumps over it"
    rows = [(1, text), (1, text)]
    assert {r.n_removed for r in substring_dedup.remove_repeats(documents(rows), width=3).collect()} == {0}
    assert {r.n_removed for r in suffix_dedup.remove_repeats(documents(rows), width=10, gram=4).collect()} == {0}


def test_very_long_text(documents):
    """One text beyond a shard; its second half repeats the first."""
    rng = random.Random(3)
    half = " ".join(str(rng.randint(0, 10**9)) for _ in range(150_000))
    row = suffix_dedup.remove_repeats(documents([(1, half + half)])).first()
    assert (row.n_bytes, row.n_removed, row.n_spans) == (2 * len(half), len(half), 1)
    row = substring_dedup.remove_repeats(documents([(1, half), (2, half)])).where("doc_id = 2").first()
    assert row.n_words == row.n_removed == 150_000


def symbols(parts):
    return np.concatenate([[*(b + 1 for b in p), 0] for p in parts]).astype(np.uint16)


@pytest.mark.parametrize("limit", [64 << 20, 200])
def test_induced_sorting(limit, monkeypatch):
    """Order and shared prefixes, with queues in memory and on disk."""
    monkeypatch.setattr(suffixes.Queue.__init__, "__defaults__", (limit,))
    rng = random.Random(limit)
    for n in range(150):
        letters = [b"ab", b"abcd\xff\x00", b"a"][n % 3]
        parts = [bytes(rng.choices(letters, k=rng.randint(1, 50))) for _ in range(rng.randint(1, 6))]
        parts += parts[: n % 3]
        depth = rng.choice([5, 7, 20, 100])
        text = symbols(parts)
        order, shared = suffixes.induced(text, depth)
        keys = [tuple(text[i : i + depth].tolist()) for i in range(len(text))]
        assert sorted(order.tolist()) == list(range(len(text)))
        for a, b, have in zip(order, order[1:], shared[1:]):
            assert keys[a] <= keys[b]
            same = next((k for k, (x, y) in enumerate(zip(keys[a], keys[b])) if x != y), None)
            if same is not None:
                assert have == same


def test_suffix_array():
    rng = random.Random(1)
    codes = np.array(rng.choices(range(4), k=300))
    order = suffixes.suffix_array(codes, 13)
    keys = [tuple(codes[i : i + 13]) for i in order]
    assert keys == sorted(keys)


def test_sampled_places_depend_on_content_only():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 500).astype(np.uint64)
    hashes[100:140] = hashes[100]
    at = suffix_dedup.sampled(hashes, 9)
    top = hashes >> np.uint64(24)
    assert [p + int(np.argmin(top[p : p + 9])) for p in range(492)] == at.tolist()


def test_blobs_come_back():
    arrays = [np.array([5, -3, 2**62]), np.array([], np.int64), np.arange(7)]
    for a, b in zip(arrays, occurrences.unpacked(occurrences.packed(*arrays))):
        assert a.tolist() == b.tolist()


def test_ranges_follow_the_input(spark, documents, tmp_path, monkeypatch):
    rows = texts(7, 200)
    documents(rows).write.parquet(f"file://{tmp_path}/docs")
    stored = spark.read.parquet(f"file://{tmp_path}/docs")
    size = occurrences.input_bytes(stored.select("doc_id", "text"))
    assert size == sum(p.stat().st_size for p in (tmp_path / "docs").glob("*.parquet"))
    assert occurrences.parts_of(stored) == 64
    monkeypatch.setattr(occurrences, "RANGE_BYTES", size // 200)
    assert occurrences.parts_of(stored) == 256
    monkeypatch.setattr(occurrences, "MANY_RANGES", 100)
    assert occurrences.parts_of(stored) == 128
    assert occurrences.parts_of(documents(rows)) == 64
    found = substring_dedup.remove_repeats(stored, width=6).collect()
    have = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found)
    assert have == sorted(brute.word_repeats(rows, 6))
