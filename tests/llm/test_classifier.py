"""Quality scores: fit against a direct solution, calibration against all splits, held-out accuracy."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keybalance.llm import classifier as C


def labelled(spark, rows):
    schema = "doc_id long, quality int, toxic int, score double, x int, fold string"
    return spark.createDataFrame([(i, q, 0, 0.0, 1, "f") for i, q in rows], schema)


def some_texts(n, seed=1):
    """Clean prose, and junk by symbols or repetition."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(5, 80))]
        bad = rnd.random() < 0.3
        if bad:
            words = [w + "###" for w in words] if rnd.random() < 0.5 else [words[0]] * len(words)
        docs.append((i, " ".join(words)))
        if rnd.random() < 0.7:
            labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_rows(spark, documents):
    docs, labels = some_texts(1500)
    found = C.score_quality(documents(docs), labelled(spark, labels))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    held = [(rows[i]["predicted"], q) for i, q in labels if rows[i]["held_out"]]
    assert len(held) > 150 and np.mean([p == q for p, q in held]) > 0.97


def test_held_out_labels_change_nothing(spark, documents):
    docs, labels = some_texts(400)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    assert turned != labels
    a, b = (sorted(map(tuple, C.score_quality(documents(docs), labelled(spark, x)).collect())) for x in (labels, turned))
    assert [r[:2] for r in a] == [r[:2] for r in b]
    assert np.allclose([r[2] for r in a], [r[2] for r in b], atol=1e-7)


def test_normal_equations_equal_the_whole_matrix(spark, documents):
    docs, labels = some_texts(300)
    rows = C.measured(documents(docs))
    train = rows.join(labelled(spark, labels).select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id").where("fold > 0")
    mapping = C.Map(np.zeros(len(C.STATISTICS)), np.ones(len(C.STATISTICS)), 1.0, 16)
    summed = C.normal_equations(train.repartition(7), mapping)
    for fold, matrix in summed.items():
        own = train.where(F.col("fold") == fold).toPandas()
        z = np.column_stack([mapping(np.stack(own["x"])), own["y"]])
        assert np.allclose(matrix, z.T @ z)
    weights = C.solve(sum(summed.values()), 1e-3)
    every = train.toPandas()
    z = mapping(np.stack(every["x"]))
    ridge = np.append(np.full(16, 1e-3 * len(z)), 1e-9 * len(z))
    assert np.allclose(weights, np.linalg.solve(z.T @ z + np.diag(ridge), z.T @ every["y"].to_numpy()))


def test_features_approximate_the_kernel():
    x = np.random.default_rng(3).standard_normal((40, len(C.STATISTICS)))
    mapping = C.Map(np.zeros(x.shape[1]), np.ones(x.shape[1]), 1.0, 8192)
    z = mapping(x)[:, :-1]
    apart = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-apart / (2 * 2 * x.shape[1]))).max() < 0.06


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_is_the_best_monotone_fit(seed):
    random_ = np.random.default_rng(seed)
    y, w = random_.integers(0, 2, 12).astype(float), random_.integers(1, 4, 12).astype(float)
    centre, level = C.isotonic(np.arange(12.0), y, w)
    assert (np.diff(level) > 0).all() and (np.diff(centre) > 0).all()
    # max-min formula of the isotonic fit
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    best = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
    assert np.allclose(level, sorted(set(np.round(best, 12))))


def test_statistics_add_up_over_pieces(spark, documents, monkeypatch):
    text = ("One two TWO ### three!\n" * 3000) + "end"
    whole = C.measured(documents([(1, text)])).first()["x"]
    monkeypatch.setattr(C, "SHARD_BYTES", 5000)
    assert np.allclose(whole, C.measured(documents([(1, text)])).first()["x"], rtol=0.01, atol=0.01)


def test_edges(spark, edges, no_rows):
    labels = labelled(spark, [(1, 1), (4, 0), (4, 1), (5, 7), (None, 0), (99, 1)])
    found = C.score_quality(edges, labels)
    assert found.count() == edges.count()
    assert found.where("doc_id is null and not held_out").isEmpty()
    assert found.where("score is null or isnan(score) or score < 0 or score > 1").isEmpty()
    same = found.where("doc_id = 4").collect()
    assert same[0] == same[1]
    assert C.score_quality(no_rows, labels).isEmpty()
    unknown = C.score_quality(edges, labels.limit(0))
    assert {r["score"] for r in unknown.collect()} == {0.5}


def test_one_kind_of_label(spark, documents):
    docs, labels = some_texts(60)
    found = C.score_quality(documents(docs), labelled(spark, [(i, 0) for i, _ in labels]))
    assert {r["predicted"] for r in found.collect()} == {0}
    found = C.score_quality(documents(docs), labelled(spark, [(i, 1) for i, _ in labels]))
    assert {r["predicted"] for r in found.collect()} == {1}
