from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.llm import mixing


def _docs(documents):
    rng = np.random.default_rng(0)
    return documents([(k, "w " * int(rng.integers(1, 400)), str(rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1])), str(rng.choice(["a", "b"]))) for k in range(600)])


def test_rake_meets_marginals():
    rng = np.random.default_rng(1)
    sides = [rng.integers(0, 4, 60), rng.integers(0, 3, 60)]
    goals = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.25, 0.25])]
    fitted = mixing.rake(rng.random(60) + 0.1, sides, goals)
    for codes, goal in zip(sides, goals):
        assert np.allclose(np.bincount(codes, fitted, len(goal)), goal, atol=1e-7)


def test_weights_meet_targets(spark, documents):
    docs = _docs(documents)
    targets = {"lang": {"en": 0.4, "de": 0.4, "fr": 0.2}, "source": {"a": 0.5, "b": 0.5}}
    found = mixing.weigh(docs, targets, budget=0.3)
    total = found.agg(F.sum(F.col("n_tokens") * F.col("weight"))).first()[0]
    for side in ("lang", "source"):
        share = {r[0]: r[1] / total for r in found.groupBy(side).agg(F.sum(F.col("n_tokens") * F.col("weight"))).collect()}
        assert share == pytest.approx(targets[side], abs=1e-6)
    spent, tokens, kept = found.agg(F.sum(F.col("n_tokens") * F.col("probability")), F.sum("n_tokens"), F.sum(F.when(F.col("kept"), F.col("n_tokens")))).first()
    assert spent / tokens == pytest.approx(0.3, abs=1e-3) and kept / tokens == pytest.approx(0.3, abs=0.05)


def test_joins_agree_with_numpy(spark, documents):
    docs = _docs(documents)
    n = mixing.tokens(F.col("text"))
    cells = docs.select("source", "lang", mixing.topic(F.col("text"), n).alias("topic"), n.alias("t")).groupBy("source", "lang", "topic").agg(F.sum("t").alias("tokens"), F.count("*").alias("n")).cache()
    a = {tuple(r)[:3]: r["weight"] for r in mixing.cell_probabilities(cells).collect()}
    rounds, mixing.ROUNDS = mixing.ROUNDS, 4
    try:
        b = {tuple(r)[:3]: r["weight"] for r in mixing.cell_probabilities(cells, most_cells=0).collect()}
    finally:
        mixing.ROUNDS = rounds
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.02 for k in a)


def test_sample_is_what_the_weights_say(spark, documents, odd_rows):
    docs = documents(odd_rows).withColumns({"id": F.lit(3), "topic": F.lit("t"), "weight": F.lit(1), "row": F.lit(0)})
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r["id"]) for r in mixing.weigh(docs).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    assert mixing.weigh(docs).count() == len(odd_rows)
    assert mixing.weigh(documents([])).count() == 0 and mixing.mixed(documents([])).count() == 0


def brute_weights(rows, targets, rounds=3_000):
    """Iterative proportional fitting in plain loops: weight of every (source, lang, topic)."""
    cells = {}
    for *cell, t in rows:
        cells[tuple(cell)] = cells.get(tuple(cell), 0) + t
    live, total = {k: t / sum(cells.values()) for k, t in cells.items() if t}, sum(cells.values())
    first = dict(live)
    for _ in range(rounds):
        for k, side in enumerate(mixing.SIDES):
            have, own = {}, {}
            for cell, x in live.items():
                have[cell[k]] = have.get(cell[k], 0) + x
                own[cell[k]] = own.get(cell[k], 0) + first[cell]
            named = {c: s for c, s in targets[side].items() if c != mixing.REST}
            others = sum(x for c, x in own.items() if c not in named)
            goal = {c: named.get(c, targets[side].get(mixing.REST, 0) * own[c] / others if others else 0) for c in own}
            scale = sum(goal.values())
            live = {cell: x * goal[cell[k]] / scale / have[cell[k]] if have[cell[k]] else 0 for cell, x in live.items()}
    return {cell: x * total / cells[cell] for cell, x in live.items()}


def test_query_against_loops(spark):
    found = mixing.op8(spark, "/root/testdata/sf0.001").collect()
    want = brute_weights([(r["source"], r["lang"], r["topic"], r["n_tokens"]) for r in found], mixing.TARGETS)
    assert len(found) > 100
    for r in found:
        key = (r["source"], r["lang"], r["topic"])
        assert r["weight"] == pytest.approx(want[key] if key in want else 1.0, abs=1e-5)
        assert r["n_tokens"] >= 0 and r["kept"] == (r["probability"] > 0 and r["kept"])


def test_joins_agree_with_loops(spark, documents, monkeypatch):
    rng = np.random.default_rng(3)
    docs = documents([(k, "w " * int(rng.integers(1, 30)), str(rng.choice(["en", "de", None])), f"s{rng.integers(0, 6)}") for k in range(80)])
    targets = {"lang": {"en": 0.5, mixing.REST: 0.5}, "source": {"s0": 0.4, mixing.REST: 0.6}, "topic": {"a": 0.3, "b": 0.7}}
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(mixing, "CELLS", 0)
    probabilities = mixing.cell_probabilities
    monkeypatch.setattr(mixing, "cell_probabilities", lambda cells, targets, budget: probabilities(cells, targets, budget, 0))
    found = mixing.weigh(docs, targets, topic_col=F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")).collect()
    want = brute_weights([(r["source"], r["lang"], r["topic"], r["n_tokens"]) for r in found], targets)
    assert len(found) == 80 and all(r["weight"] == pytest.approx(want[r["source"], r["lang"], r["topic"]], abs=0.02) for r in found)
