"""Nested pixels, their neighbours, and catalogues stored by pixel."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.functions import sky
from skysieve.operators import pixels
from skysieve.session import cut


def separation(a, b):
    ra1, dec1, ra2, dec2 = map(math.radians, (*a, *b))
    u, v = math.sin((dec2 - dec1) / 2), math.sin((ra2 - ra1) / 2)
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(u * u + math.cos(dec1) * math.cos(dec2) * v * v)))) * 3600


def positions(seed, n):
    """Random positions, with poles, the zero meridian, pixel corners and repeats among them."""
    rng = np.random.default_rng(seed)
    out = [(float(a), float(b)) for a, b in zip(rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))))]
    for ra in (0.0, 45.0, 90.0, 180.0, 269.9999, 359.99999, -0.0001, 400.0):
        out += [(ra, d) for d in (-90.0, -89.9995, -41.810314895778596, -41.8103, 0.0, 41.8103149, 89.9999, 90.0)]
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_neighbours_share_corners(spark, order):
    """Against pixels that share a corner: the in-face corners of all pixels, as positions."""
    n, total = 1 << order, 12 << (2 * order)
    ids = spark.range(total).select(F.col("id").alias("pixel"))
    found: dict[int, set[int]] = {}
    for r in pixels.neighbours(ids, "pixel", order, "to").collect():
        found.setdefault(r["pixel"], set()).add(r["to"])
    corners: dict[tuple, set[int]] = {}
    for p in range(total):
        face, inner = p >> 2 * order, p & (n * n - 1)
        x = sum((inner >> 2 * k & 1) << k for k in range(order))
        y = sum((inner >> 2 * k + 1 & 1) << k for k in range(order))
        for u, v in ((x, y), (x + 1, y), (x, y + 1), (x + 1, y + 1)):
            down = (face // 4 + 2) * n - u - v  # rows below the pole, as lines of corners
            wide = down if down < n else 4 * n - down if down > 3 * n else n
            z = 1 - down**2 / (3 * n * n) if down < n else (4 * n - down) ** 2 / (3 * n * n) - 1 if down > 3 * n else (2 * n - down) * 2 / (3 * n)
            across = 2 * (face % 4) + (0 if face // 4 == 1 else 1)
            ra = (across * wide + u - v) * 45.0 / wide % 360 if wide else 0.0
            corners.setdefault((round(z, 9), round(ra, 7) % 360), set()).add(p)
    want: dict[int, set[int]] = {}
    for sharing in corners.values():
        for p in sharing:
            want.setdefault(p, set()).update(sharing - {p})
    assert found == want


def test_centres_and_reach(spark):
    for order in (0, 3, 8):
        ra, dec = sky.healpix_centre(F.col("id"), order)
        centres = spark.range(0, 12 << (2 * order), 1 if order < 4 else 97).select("id", ra.alias("ra"), dec.alias("dec"))
        assert cut(centres).where(sky.healpix_nested("ra", "dec", order) != F.col("id")).isEmpty()
        points = spark.createDataFrame(positions(order, 3_000), "ra double, dec double")
        at = cut(pixels.with_pixel(points, order))
        c = sky.healpix_centre(F.col("pixel"), order)
        assert at.where(sky.sep_degrees("ra", "dec", *c) > sky.healpix_reach(order)).isEmpty()


@pytest.mark.parametrize(("order", "radius"), [(3, 3_000.0), (6, 600.0), (8, 5.0), (8, 300.0)])
def test_circles_stay_in_the_pixels_reached(spark, order, radius):
    """Points on the rim of each circle lie in a pixel that the seed was copied to."""
    seeds = spark.createDataFrame([(k, *p) for k, p in enumerate(positions(order, 2_000))], "id long, ra double, dec double")
    copied = cut(pixels.reached(seeds, radius, order))
    assert copied.groupBy("id", "pixel").count().where("count > 1").isEmpty()
    r, turn = math.radians(radius / 3600 * (1 - 1e-9)), F.radians(F.col("k") * 15.0)
    d = F.radians(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("dec"))))
    d2 = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(d) * math.cos(r) + F.cos(d) * math.sin(r) * F.cos(turn))))
    step = F.atan2(F.sin(turn) * math.sin(r) * F.cos(d), math.cos(r) - F.sin(d) * F.sin(d2))
    rim = seeds.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(23)))).select("id", sky.wrap360(F.col("ra") + F.degrees(step)).alias("ra"), F.degrees(d2).alias("dec"))
    assert pixels.with_pixel(cut(rim), order).join(copied.select("id", "pixel"), ["id", "pixel"], "left_anti").isEmpty()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    base = positions(11, 600)
    rng = np.random.default_rng(1)
    near = [(ra + float(rng.uniform(-3e-3, 3e-3)), max(-90.0, min(90.0, dec + float(rng.uniform(-2e-3, 2e-3))))) for ra, dec in base]
    rows = [(k, *p, k % 3) for k, p in enumerate(near)] + [(9_000, float("nan"), 1.0, 1), (9_001, None, 2.0, 1), (9_002, *base[3], 0), (9_003, *base[3], 1), (9_004, *base[3], 1)]
    frame = spark.createDataFrame(rows, "key long, ra double, dec double, good int").withColumn("more", F.lit("x"))
    return base, rows, pixels.write_catalogue(frame, str(tmp_path_factory.mktemp("pixels") / "c"), order=8, leaf_order=1, buckets=4)


def test_pairs_and_nearest_against_all(spark, stored):
    base, rows, catalogue = stored
    seeds = spark.createDataFrame([(k, *p) for k, p in enumerate(base)] + [(-1, float("nan"), 0.0), (-2, None, None)], "id long, ra double, dec double")
    good = [r for r in rows if r[1] is not None and not math.isnan(r[1]) and r[3] > 0]
    want = {(k, r[0]) for k, p in enumerate(base) for r in good if separation(p, r[1:3]) <= 5.0}
    found = pixels.pixel_pairs(seeds, catalogue, 5.0, gate=lambda d: d.where("good > 0"), columns=["key"])
    assert found.columns == ["id", "ra", "dec", "key", "ra_c", "dec_c", "sep_arcsec"]
    assert sorted((r["id"], r["key"]) for r in found.collect()) == sorted(want) and len(want) > 50
    place = {r[0]: r[1:3] for r in good}
    best = {}
    for k, key in want:
        best.setdefault(k, []).append((separation(base[k], place[key]), key))
    nearest = pixels.pixel_nearest(seeds, catalogue, 5.0, "id", "key", gate=lambda d: d.where("good > 0")).collect()
    assert {r["id"] for r in nearest} == set(best)
    for r in nearest:  # at the poles many rows are equally near up to rounding
        least = min(best[r["id"]])[0]
        assert abs(separation(base[r["id"]], place[r["key"]]) - least) < 1e-6
        if sum(x[0] < least + 1e-6 for x in best[r["id"]]) == 1:
            assert r["key"] == min(best[r["id"]])[1]
    hot = [r["key"] for r in nearest if r["id"] == 3]
    assert hot == [min(k for s, k in best[3] if s < 1e-9)]


def test_the_catalogue_stays_and_few_leaves_are_read(spark, stored):
    _, _, catalogue = stored
    seeds = spark.createDataFrame([(k, 10.0 + k / 50, 20.0) for k in range(40)], "id long, ra double, dec double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = pixels.pixel_pairs(seeds, catalogue, 5.0)._jdf.queryExecution().executedPlan().toString()
        joined = plan[plan.index("SortMergeJoin") :]
        assert "Bucketed: true" in plan and "LocationPartition" not in plan
        stored_side = joined[joined.rindex(":-") if "Bucketed: true" in joined[joined.rindex(":-") :] else joined.rindex("+- Sort") :]
        assert "Exchange" not in stored_side[: stored_side.index("Bucketed: true")].split("FileScan")[-1]
        assert joined.count("Exchange hashpartitioning(__pixel") == 1 and joined.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    leaves = catalogue.leaves_of(pixels.reached(seeds, 5.0, catalogue.order))
    read, whole = catalogue.read(spark, leaves), catalogue.read(spark)
    assert len(leaves) == 1 and whole.select("leaf").distinct().count() > 40
    assert read.select("leaf").distinct().count() == 1
    files = lambda d: {f.rsplit("/", 1)[0] for f in d.select("key").inputFiles()}
    assert read.select(F.input_file_name()).distinct().count() < len(whole.inputFiles())
    assert "PartitionFilters: [isnotnull(leaf" in read._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [leaf" in read._jdf.queryExecution().executedPlan().toString()
    assert len(files(whole)) > 40


def test_a_stored_catalogue_is_opened_again(spark, stored):
    _, rows, catalogue = stored
    again = pixels.open_catalogue(spark, catalogue.path)
    assert again == catalogue
    spark.sql(f"DROP TABLE {catalogue.name}")
    assert again.read(spark).count() == len(rows) - 2
    with pytest.raises(ValueError, match="too wide"):
        pixels.reached(again.read(spark), 5_000.0, 8)


def test_buckets_grow_with_the_table():
    assert [pixels.buckets_for(s) for s in (0, 1 << 28, 1 << 33, 1 << 60)] == [8, 8, 256, 4096]
