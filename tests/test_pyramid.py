"""Nearest partner at any distance, against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.operators import pyramid, skyjoin
from skysieve.session import cut


def unit(ra, dec):
    ra, dec = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], 1)


def check(spark, left, right, leaf):
    a = spark.createDataFrame([(k, *p) for k, p in enumerate(left)], "id long, ra double, dec double")
    b = spark.createDataFrame([(k, *p, f"r{k}") for k, p in enumerate(right)], "cat long, ra double, dec double, more string")
    got = pyramid.nearest(a, b, "id", "cat", leaf=leaf)
    assert got.columns == ["id", "ra_1", "dec_1", "cat", "ra_2", "dec_2", "more", "sep_arcsec"]
    found = {r["id"]: r for r in got.collect()}
    good = [k for k, (r, d) in enumerate(right) if r is not None and math.isfinite(r) and math.isfinite(d)]
    fine = [k for k, (r, d) in enumerate(left) if r is not None and math.isfinite(r) and math.isfinite(d)]
    assert set(found) == (set(fine) if good else set())
    if not good:
        return
    u = unit(*np.array([right[k] for k in good]).T)
    for k in fine:
        gaps = np.linalg.norm(u - unit(*np.array([left[k]]).T), axis=1)
        r = found[k]
        assert r["more"] == f"r{r['cat']}"
        mine = gaps[good.index(r["cat"])]
        assert mine <= gaps.min() + 1e-9
        same = [good[i] for i in np.nonzero(gaps == gaps.min())[0]]
        if np.sum(gaps < gaps.min() + 1e-9) == len(same) and len({right[i] for i in same}) == 1:
            assert r["cat"] == min(same)
        assert abs(math.radians(r["sep_arcsec"] / 3600) - 2 * math.asin(min(1, mine / 2))) < 1e-8


def sky_points(rng, n):
    return [(float(a), float(b)) for a, b in zip(rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))))]


EDGES = [(0.0, 90.0), (10.0, -90.0), (0.0, 0.0), (359.99999, 0.0), (-0.00001, 0.0), (45.0, 41.8103149), (400.0, 12.0), (180.0, 89.99999)]


@pytest.mark.parametrize("leaf", [2, 8])
def test_spread_and_crowded(spark, leaf):
    rng = np.random.default_rng(leaf)
    crowd = [(120.0 + float(x), -30.0 + float(y)) for x, y in rng.normal(0, 1e-3, (60, 2))]
    right = sky_points(rng, 150) + crowd + [(200.0, 10.0)] * 40 + EDGES + [(float("nan"), 1.0), (None, 0.0)]
    left = sky_points(rng, 200) + EDGES + crowd[:20] + [(200.0, 10.0), (20.0, -10.0), (None, 1.0), (1.0, float("inf"))]
    check(spark, left, right, leaf)


def test_one_far_partner_and_none(spark):
    check(spark, sky_points(np.random.default_rng(3), 30) + EDGES, [(77.0, -12.0)], 4)
    check(spark, EDGES, [(float("nan"), 0.0)], 4)


def test_few_leaves_are_compared(spark):
    """However the right side crowds, a left row meets a bounded number of leaves of LEAF positions at most."""
    rng = np.random.default_rng(9)
    right = sky_points(rng, 400) + [(120.0 + float(x), -30.0 + float(y)) for x, y in rng.normal(0, 1e-2, (700, 2))]
    b = spark.createDataFrame([(k, *p) for k, p in enumerate(right)], "cat long, ra double, dec double")
    a = spark.createDataFrame([(k, *p) for k, p in enumerate(sky_points(rng, 300) + right[-100:])], "__id long, __lra double, __ldec double")
    levels, placed = pyramid.build(b, "cat", leaf=16)
    near = cut(pyramid.leaves_within_reach(a, "__id", levels))
    assert near.groupBy("__id").count().agg(F.max("count")).first()[0] <= 40
    assert placed.groupBy("__level", "__pixel").count().agg(F.max("count")).first()[0] <= 16
    assert skyjoin.nearest(a.selectExpr("__id AS id", "__lra AS ra", "__ldec AS dec"), b.withColumnsRenamed({"ra": "r", "dec": "d"}), "id", "cat", right_coords=("r", "d")).count() == 400


def test_cells_of_many_leaves_go_row_by_row(spark):
    """A crowd far from every left row leaves its cells more leaves than a list may hold."""
    rng = np.random.default_rng(5)
    crowd = [(120.0 + float(x), -30.0 + float(y)) for x, y in rng.normal(0, 1e-3, (80, 2))]
    a = spark.createDataFrame([(k, *p) for k, p in enumerate(sky_points(rng, 40))], "id long, ra double, dec double")
    b = spark.createDataFrame([(k, *p) for k, p in enumerate(crowd)], "cat long, r double, d double")
    found = {many: sorted(map(tuple, pyramid.nearest(a, b, "id", "cat", right_coords=("r", "d"), leaf=2, many=many).collect())) for many in (3, 1000)}
    assert found[3] == found[1000] and len(found[3]) == 40


def test_nearest_within_a_wide_limit_moves_no_pairs(spark):
    """Plates that overlap a hundredfold: each row leaves the join once, and the answers are those of all pairs."""
    from skysieve.operators import plates

    rng = np.random.default_rng(6)
    held = [(k, 100.0 + float(x), 20.0 + float(y)) for k, (x, y) in enumerate(rng.uniform(-2, 2, (150, 2)))]
    p = spark.createDataFrame(held, "plate_id long, ra0 double, dec0 double")
    rows = [(k, 100.0 + float(x), 20.0 + float(y)) for k, (x, y) in enumerate(rng.uniform(-8, 8, (200, 2)))] + [(900, None, 1.0)]
    out = plates.nearest_plate(spark.createDataFrame(rows, "id long, ra double, dec double"), p, "id")
    assert "__zone" not in out._jdf.queryExecution().toString()
    u = unit(*np.array([h[1:] for h in held]).T)
    for r in out.collect():
        gap = np.degrees(2 * np.arcsin(np.linalg.norm(u - unit(*np.array([[r["ra"], r["dec"]]]).T), axis=1) / 2)) if r["ra"] is not None else np.array([9.0])
        assert r["plate_id"] == (int(gap.argmin()) if gap.min() <= 3.5 else None)
