from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skysieve.llm import clusters

TOP = (1 << 63) - 1


def nearest(x, centroids):
    found = [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))]
    return found[0][1], min(found[0][0], TOP)


def slow(rows, k, rounds, seed, dim, scale=256):
    """Whole numbers, centroids and assignments with Python's integers."""
    kept = []
    for d, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((d, [max(-TOP, min(TOP, math.floor(x * scale))) for x in v]))
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v, centroids)[0], []).append(v)
        centroids = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else old for i, old in enumerate(centroids)]
    return [(d, *nearest(v, centroids)) for d, v in kept], centroids


def compare(spark, rows, k=4, rounds=3, dim=6):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = clusters.clustered(frame, dim=dim, k=k, rounds=rounds).collect()
    want, centroids = slow(rows, k, rounds, clusters.SEED, dim)
    assert sorted((repr(r["id"]), r["cluster"], r["distance"]) for r in got) == sorted((repr(a), b, c) for a, b, c in want)
    total = min(TOP, sum(w[2] for w in want))
    for r in got:
        assert r["centroid"] == centroids[r["cluster"]] and r["inertia"] == total
        assert r["cluster_inertia"] == min(TOP, sum(w[2] for w in want if w[1] == r["cluster"]))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_against_integers(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (3, 6))
    rows = [(k, (centres[k % 3] + rng.normal(0, 0.2, 6)).tolist()) for k in range(200)]
    compare(spark, rows)


def test_cases(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 6)]) for k in range(60)]  # many ties
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (70, None), (71, []), (72, [1.0] * 5), (73, [1.0] * 5 + [None]), (74, [float("nan")] * 6), (75, [float("inf")] + [0.0] * 5)]
    compare(spark, rows)
    compare(spark, rows + [(80, [1e30, -1e30, 0.0, 1e18, -3e9, 0.5]), (81, [3e9] * 6), (82, [-3e9, 3e9, 0.0, 0.0, 0.0, 0.1])], k=8)
    assert len(compare(spark, rows[:2], k=5)) == 2
    assert clusters.clustered(spark.createDataFrame([], "vec_id long, embedding array<double>"), dim=6).count() == 0


def test_hot_copies_and_other_columns(spark):
    rows = [(k, [0.5] * 6) for k in range(300)] + [(1_000 + k, [k / 7.0, -k / 3.0, 0.0, 1.0, 2.0, 0.25]) for k in range(100)]
    compare(spark, rows)
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("x")).withColumn("id", F.lit(0)).withColumn("a.b", F.lit(1))
    assert clusters.clustered(odd, dim=6, k=4).count() == 400


@given(st.integers(0, 2**32), st.sampled_from([4, 300, 1 << 20, 1 << 26, 1 << 40, 1 << 62]), st.integers(1, 64))
@settings(max_examples=120, deadline=None)
def test_intervals_hold_the_exact_values(seed, size, dim):
    """Whatever the magnitudes: intervals hold the exact value, and assignment is that of Python's integers."""
    rng = np.random.default_rng(seed)
    centroids = rng.integers(-size, size + 1, (7, dim))
    x = np.concatenate([rng.integers(-size, size + 1, (9, dim)), centroids, centroids + rng.integers(-1, 2, (7, dim))]).clip(-TOP, TOP)
    screen = clusters.Screen(centroids.astype(np.int64))
    low, high = screen.intervals(x)
    for i, row in enumerate(x.tolist()):
        for k, c in enumerate(centroids.tolist()):
            exact = sum(b * b for b in c) - 2 * sum(a * b for a, b in zip(row, c))
            assert low[i, k] <= exact <= high[i, k]
    cluster, distance = screen.assign(x)
    assert [(int(a), int(b)) for a, b in zip(cluster, distance)] == [nearest(r, centroids.tolist()) for r in x.tolist()]


def test_one_candidate_for_most():
    """Screening leaves about one centroid a vector: the exact part is small."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(-300, 300, (40, 64))
    rows, _ = clusters.Screen(centroids).shortlist(rng.integers(-300, 300, (2_000, 64)))
    assert len(rows) < 2_100
