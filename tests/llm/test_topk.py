from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.llm import topk


def brute(rows, k, every=20):
    ints = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ints:
        if q % every == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in ints if i != q and len(b) == len(a))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("seed,block", [(0, 1_024), (1, 16)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "CANDIDATES", 2 * block)
    monkeypatch.setattr(topk, "HEAD", block)
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=8) * 10 ** rng.uniform(-2, 2))]) for k in range(150)]
    rows += [(200 + k, [1.0] * 8) for k in range(40)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [math.inf] * 8), (320, []), (321, []), (340, [0.0] * 8), (360, [2.0, 3.0]), (361, [3e30, -3e30]), (380, [3e30, 3e30]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(5), "block": F.lit(1), "score": F.lit(2)})
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table, F.col("id") % 20 == 0, k=7).collect()}
    want = brute(rows, 7)
    assert {x for x in got if x[0] not in (320,)} == {x for x in want if x[0] not in (320,)}
    assert {x for x in got if x[0] == 320} == {(320, 1, 321, 0)}


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0


def test_pruning_keeps_all_that_reach_the_bound():
    rng = np.random.default_rng(3)
    others = np.floor(rng.normal(size=(400, 6)) * 40)
    others = others[np.argsort(-np.sqrt((others**2).sum(1)), kind="stable")]
    lengths = np.sqrt((others**2).sum(1))
    for _ in range(200):
        q = np.floor(rng.normal(size=6) * rng.choice([1, 30]))
        scores = others @ q
        for bound in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]).tolist():
            kept = set(topk.candidates(q, float(np.sqrt(q @ q)), bound, others, lengths).tolist())
            assert set(np.nonzero(scores >= bound)[0].tolist()) <= kept
