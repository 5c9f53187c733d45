from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.llm import toxicity


def _corpus(documents, spark, n=400):
    rng = np.random.default_rng(0)
    words, bad = [f"word{k}" for k in range(400)], ["vile", "nasty", "scum"]
    rows, labels = [], []
    for k in range(n):
        text = list(rng.choice(words, 60))
        toxic = k % 8 == 0
        if toxic:
            text[::20] = bad
        rows.append((k, " ".join(text)))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows(spark, documents):
    docs, labels = _corpus(documents, spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    found = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [k for k in found if k % 5 == 0]
    assert sum(found[k] >= 0.5 for k in held if k % 8 == 0) >= 0.9 * sum(k % 8 == 0 for k in held)
    assert sum(found[k] >= 0.5 for k in held if k % 8) <= 0.05 * len(held)


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows).withColumns({"id": F.lit(0), "words": F.lit("w"), "positive": F.lit(True), "score": F.lit(9)})
    labels = spark.createDataFrame([(4, 1), (4, None), (None, 1), (5, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["id"] in (1, 2, 6)}) == 1


def test_no_positive_and_empty(spark, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents([(1, "a")]), none, F.lit(True), prior=0.2)
    assert abs(toxicity.score(documents([(1, "a")]), model).first()["score"] - 0.2) < 1e-9
    assert toxicity.score(documents([]), model).count() == 0


def test_risk_is_not_driven_below_zero():
    # every unlabelled row looks like a positive: the negative part would go below zero without the correction
    rows, cols = np.repeat(np.arange(20), 1), np.zeros(20, int)
    w, b = toxicity.nnpu(rows, cols, np.arange(20) < 10, 1, 0.3)
    assert np.isfinite(w).all() and np.isfinite(b) and abs(b) < 50


def test_risk_against_loops():
    rng = np.random.default_rng(2)
    scores, positive, prior = rng.random(60), np.arange(60) < 20, 0.2
    p_plus = sum(1 - s for s, y in zip(scores, positive) if y) / 20
    u_minus = sum(s for s, y in zip(scores, positive) if not y) / 40
    p_minus = sum(s for s, y in zip(scores, positive) if y) / 20
    assert toxicity.risk(scores, positive, prior) == pytest.approx(prior * p_plus + max(0.0, u_minus - prior * p_minus))
    assert toxicity.risk(np.where(positive, 1.0, 0.0), positive, prior) == 0.0  # the negative part stops at zero


def test_fit_lowers_the_risk():
    rng = np.random.default_rng(4)
    n, d, prior = 600, 12, 0.15
    hidden = rng.random(n) < prior
    rows, cols = np.nonzero(np.where(hidden[:, None], rng.random((n, d)) < 0.5, rng.random((n, d)) < 0.1))
    picked = np.nonzero(hidden)[0][:40]  # these are in both samples
    again = np.concatenate([cols[rows == i] for i in picked])
    pairs = (np.concatenate([rows, np.repeat(n + np.arange(len(picked)), [np.sum(rows == i) for i in picked])]), np.concatenate([cols, again]))
    positive = np.arange(n + len(picked)) >= n
    w, b = toxicity.nnpu(*pairs, positive, d, prior)
    score = lambda w, b: 1 / (1 + np.exp(-(np.bincount(pairs[0], w[pairs[1]], len(positive)) + b)))
    best = toxicity.risk(score(w, b), positive, prior)
    assert best < 0.6 * toxicity.risk(score(np.zeros(d), np.log(prior / (1 - prior))), positive, prior)
    assert all(best < toxicity.risk(score(w + 2 * rng.normal(size=d), b), positive, prior) for _ in range(20))


def test_query_against_a_brute_force_score(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    counts = {bytes(r["w"]): r["n"] for r in toxicity.word_counts(docs).collect()}
    assert counts == Counter(w for t in texts.values() for w in toxicity.words(t))
    model = toxicity.fit(docs, labels, toxicity.fold("doc_id", 5) != 0)
    for r in toxicity.op1(spark, d).collect():
        logit = model.bias + sum(x for w, x in model.weights.items() if w in toxicity.words(texts[r["doc_id"]]))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit))) and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_repeated_ids_teach_once(spark, documents):
    docs = documents([(1, "vile scum here")] * 30 + [(k, "plain words here") for k in range(2, 40)])
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), F.lit(True), max_positive=5, max_unlabelled=20)
    assert toxicity.score(docs, model).count() == 68
