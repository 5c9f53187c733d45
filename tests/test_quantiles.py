"""Quantiles by selection against sorted values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.operators import quantiles


def interpolated(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    return values[low] if low == high or values[low] == values[high] else (high - at) * values[low] + (at - low) * values[high]


def test_scopes_against_sorted_values(spark, monkeypatch):
    """Spread, tied, skewed and tiny scopes, null and unusable values, a null group; every value is narrowed to."""
    monkeypatch.setattr(quantiles, "FEW", 20)
    rng = np.random.default_rng(2)
    scopes = {
        "spread": rng.normal(0, 1, 3_000).tolist(),
        "tied": [5.0] * 2_000 + rng.normal(5, 1e-9, 500).tolist() + [7.0] * 1_500,
        "skewed": (10.0 ** rng.uniform(-300, 300, 2_500)).tolist(),
        "edge": [1.0] * 900 + [2.0] * 900,
        "one": [3.5],
        None: (-np.abs(rng.normal(0, 1, 1_200))).tolist(),
    }
    rows = [(g, float(v)) for g, vs in scopes.items() for v in vs] + [("spread", None), ("tied", float("nan")), ("none", None), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {g: [interpolated(v, q) for q in (0.0, 0.5, 0.9, 0.95, 1.0)] for g, v in scopes.items()}
    got = quantiles.exact(df, "v", (0.0, 0.5, 0.9, 0.95, 1.0), ["g"], gather=100)
    assert got.columns == ["g", "n", "p00", "p50", "p90", "p95", "p100"]
    found = {r["g"]: r for r in got.collect()}
    assert set(found) == set(scopes)
    for g, values in scopes.items():
        assert found[g]["n"] == len(values) and list(found[g])[2:] == want[g], g
    plain = {r["g"]: list(r)[2:] for r in quantiles.exact(df, "v", (0.0, 0.5, 0.9, 0.95, 1.0), ["g"]).collect()}
    assert plain == want


@pytest.mark.parametrize("n", [1, 2, 4_001])
def test_whole_table(spark, monkeypatch, n):
    monkeypatch.setattr(quantiles, "FEW", 5)
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 1.25).otherwise(F.pmod(F.col("id") * 7919, F.lit(1009)) / 7.0).alias("v"))
    values = [r[0] for r in df.collect()]
    (row,) = quantiles.exact(df, "v", (0.25, 0.5, 0.99), gather=0).collect()
    assert row["n"] == n and list(row)[1:] == [interpolated(values, q) for q in (0.25, 0.5, 0.99)]


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert [tuple(r) for r in quantiles.exact(df, "v", (0.5,)).collect()] == [(0, None)]
    assert quantiles.exact(df.withColumn("g", F.lit(1)), "v", (0.5,), ["g"], gather=0).count() == 0


def test_tasks_hold_few_values(spark, monkeypatch):
    """The plan of a whole-table scope has no aggregate that collects values: only sketches, counts and numbered brackets."""
    kept = []
    cut = quantiles.cut
    monkeypatch.setattr(quantiles, "FEW", 50)
    monkeypatch.setattr(quantiles, "cut", lambda d: kept.append(d._jdf.queryExecution().optimizedPlan().toString()) or cut(d))
    out = quantiles.exact(spark.range(20_000).select((F.pmod(F.col("id") * 104729, F.lit(19_997)) / 3.0).alias("v")), "v", (0.5, 0.9), gather=0)
    text = " ".join(kept) + out._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in text and "collect_list(__x" not in text and "collect_list(v" not in text and "percentile_approx" in text


def test_few_brackets_are_broadcast(spark):
    """Whatever the planner's estimates say, values aren't shuffled by scope."""
    values = spark.range(10).selectExpr("'all' AS __scope", "CAST(id AS DOUBLE) AS __x")
    brackets = spark.createDataFrame([("all", 1, 2.0, 5.0)], "__scope string, __rank long, __lo double, __hi double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = quantiles._inside(values, brackets)
        assert "BroadcastExchange" in met._jdf.queryExecution().executedPlan().toString() and met.count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
