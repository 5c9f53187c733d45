from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.operators import lookups
from skysieve.plans import composites
from skysieve.plans.derived import catalogue, detections

D = "/root/testdata/sf0.001"


def test_lookups(spark):
    cat = spark.createDataFrame([(1, 10.0, 0.0), (2, 10.0, 0.001), (3, 50.0, 0.0)], "k int, ra double, dec double")
    assert lookups.cone(cat, 10.0, 0.0, 5.0).count() == 2 and lookups.nearest_in_cone(cat, 10.0, 0.0008, 5.0, "k").first()["k"] == 2
    rows = spark.createDataFrame([("1.0",), ("2",), ("x",)], "NUMBER string")
    assert [r["matched"] for r in lookups.match_report(rows, spark.createDataFrame([(1,)], "NUMBER int")).orderBy("NUMBER").collect()] == [True, False, False]
    assert lookups.join_rounded(cat, cat.withColumn("ra", F.col("ra") + 1e-9)).count() == 3
    assert lookups.matched_ids(cat, "f").count() == 0 and lookups.matched_ids(cat.withColumnRenamed("k", "objID"), "f").count() == 3
    hits = spark.createDataFrame([("a", None, "m"), ("b", "1.5", None), ("c", "nan", "m")], "src_id string, angDist string, mag string")
    assert [r[0] for r in hits.select(lookups.is_hit(hits.columns)).collect()] == [False, True, False]
    bare = hits.drop("angDist")
    assert [r[0] for r in bare.select(lookups.is_hit(bare.columns)).collect()] == [True, False, True]
    master = spark.createDataFrame([("t", 7, 1.0, 2.0), (None, 8, 1.0, 2.0)], "tile_id string, NUMBER int, ra_deg double, dec_deg double")
    assert sorted(r[0] for r in lookups.seed(master).select("opt_source_id").collect()) == ["8", "t#7"]
    src = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "src_id string, plate_id string")
    dated = lookups.with_epoch(src, spark.createDataFrame([("a", 1.0)], "src_id string, epoch_mjd double"), spark.createDataFrame([("p", 2.0)], "plate_id string, epoch_mjd double"), 3.0)
    assert {r["src_id"]: r["epoch_mjd"] for r in dated.collect()} == {"a": 1.0, "b": 2.0, "c": 3.0}


def test_late_filters_and_orders(spark):
    rows = detections(spark, D).dropDuplicates(["src_id"])
    stars = catalogue(spark, D).where("rmag > 0").withColumnRenamed("cat_id", "star_id")
    kept, reasons = composites.late_filters(rows, stars)
    assert reasons.count() == rows.count()
    assert kept.count() == reasons.where("reject_reason IS NULL AND NOT spike_reject").count()
    survivors, account = composites.veto_then_filter(rows, [("gaia", catalogue(spark, D, "gaia"))], None)
    assert survivors.count() <= account.first()["n_after"] and "gaia" in composites.funnel_markdown(account)
    assert composites.filter_then_match(rows, {"gaia": catalogue(spark, D, "gaia")}, None).kept.count() <= rows.count()


def test_exports_and_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([("t", k, 10.0 + k / 10, 0.0, k % 3 == 0, k % 2, 0) for k in range(12)], "tile_id string, NUMBER int, ra double, dec double, big boolean, ra_bin int, dec_bin int")
    side = rows.where("NUMBER < 5").select("tile_id", "NUMBER", F.lit(True).alias("hpm"))
    out = composites.masked_view(rows, {"hpm": (side, ["tile_id", "NUMBER"])}, "exclude_hpm", {"hpm": "hpm"}, str(tmp_path / "v"))
    assert out.count() == 7 and spark.read.parquet(str(tmp_path / "v")).count() == 7 and "big" in out.columns
    frames = rows.select(F.col("NUMBER").cast("long").alias("cntr"), "ra", "dec", F.lit(1).alias("qual_frame"), F.lit(1.0).alias("qi_fact"), F.lit(1.0).alias("saa_sep"), F.lit(9.0).alias("w1snr"), F.lit(59000.0).alias("mjd"), F.lit("0").alias("moon_masked"))
    seeds = rows.select(F.concat_ws("#", "tile_id", "NUMBER").alias("opt_source_id"), "ra", "dec")
    assert composites.infrared_sidecar(seeds, frames.unionByName(frames)).count() == 12
    limits = composites.bounds_of(seeds, 5.0)
    assert composites.prune(frames, limits).count() == 12
    found, rest = composites.science_match(rows.select(F.col("NUMBER").alias("row_id"), "ra", "dec"), rows.where("NUMBER > 3").select(F.col("NUMBER").alias("src_id"), "ra", "dec"))
    assert (found.count(), rest.count()) == (8, 4)
    rates = {r["radius_arcsec"]: r["rate"] for r in composites.compare_radii(seeds, frames, (2.0, 5.0), "opt_source_id", "cntr").collect()}
    assert rates == {2.0: 1.0, 5.0: 1.0}
