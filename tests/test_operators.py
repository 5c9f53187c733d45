from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.operators import dedup, filters, fit, flags, plates, spikes
from skysieve.plans import stages

NAN = float("nan")


def test_clip_keeps_all_when_sigma_is_zero(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 9.0), ("a", NAN), ("a", None), ("b", 1.0), ("b", 2.0), ("b", 3.0), ("b", 100.0)], "tile_id string, x double")
    kept = sorted((r["tile_id"], r["x"]) for r in filters.robust_clip(rows, ["x"], ["tile_id"]).collect())
    assert kept == [("a", 1.0), ("a", 1.0), ("a", 9.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)]


def test_reasons_agree_with_filters(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "t", int(rng.integers(0, 2)), float(rng.uniform(20, 60)) if k % 9 else NAN, float(rng.normal(4, 1)), float(rng.normal(1.1, 0.1)), float(rng.normal(0, 0.002)), float(rng.uniform(0, 6)), 0.0, float(rng.uniform(0, 6)), 0.0) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, tile_id string, FLAGS int, SNR_WIN double, FWHM_IMAGE double, ELONGATION double, SPREAD_MODEL double, XMAX_IMAGE double, XMIN_IMAGE double, YMAX_IMAGE double, YMIN_IMAGE double")
    kept = {r["id"] for r in filters.morphology(filters.extract_gate(df), ["tile_id"]).collect()}
    reasons = filters.reject_reasons(df, ["tile_id"])
    assert {r["id"] for r in reasons.where("reject_reason IS NULL").collect()} == kept and kept
    tally = {r["reason"]: r["n"] for r in filters.reason_tallies(reasons).collect()}
    assert tally["kept"] == len(kept) and tally["flags"] == sum(r[2] for r in rows)
    assert filters.extract_gate(df.drop("FLAGS", "SNR_WIN")).count() == 400


def test_gates(spark):
    df = spark.createDataFrame([(1, 0.05), (2, 4.0), (3, 5.5), (4, NAN), (5, 0.001)], "id int, sep double")
    assert [r["id"] for r in filters.within_arcsec(df, "sep").collect()] == [1, 2, 5]
    assert [r["id"] for r in filters.within_arcsec(df, "sep", unit="guess").collect()] == [2, 5]
    assert [r["id"] for r in filters.within_arcsec_by_table(df.where("id = 3"), "sep").collect()] == []
    south = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, None)], "id int, dec double")
    assert [r["id"] for r in filters.southern_cut(south).collect()] == [2, 3]
    assert filters.xy_bounds(df.withColumnRenamed("sep", "X_IMAGE"), x=(4.0, 5.5)).count() == 2


@pytest.mark.parametrize("sep,mag,reject", [(30.0, 12.60, False), (5.0, 12.40, True), (30.0, 12.40, True), (30.0, 12.59, True), (91.0, 5.0, False), (5.0, -999.0, False)])
def test_spike_boundaries(spark, sep, mag, reject):
    det = spark.createDataFrame([("d", 10.0, 0.0)], "src_id string, ra double, dec double")
    star = spark.createDataFrame([(1, 10.0, sep / 3600.0, mag)], "star_id int, ra double, dec double, rmag double")
    row = spikes.judged(spikes.near_bright(det, star, "src_id")).first()
    assert row["spike_reject"] is reject and bool(row["spike_reason"]) is reject


def test_spike_reason_text(spark):
    df = spark.createDataFrame([(5.0, 12.0)], "bright_sep_arcsec double, bright_mag double")
    assert spikes.judged(df).first()["spike_reason"] == "CONST(m*=12.00 <= 12.40);LINE(m*=12.00 < -0.090*5.0+15.30=14.85)"
    assert spikes.rules_from([{"const_max_mag": 11}, {"a": -0.1, "b": 14}]) == (spikes.ConstRule(11.0), spikes.LineRule(-0.1, 14.0))


def test_chain_is_one_cluster(spark):
    step = 1.5 / 3600
    rows = [(f"s{k}", 10.0 + k * step, 0.0, "p") for k in range(6)] + [("far", 20.0, 0.0, "p"), ("other", 10.0, 0.0, "q")]
    df = spark.createDataFrame(rows, "src_id string, ra double, dec double, plate_id string")
    for frame in (df, df.orderBy(F.desc("src_id"))):
        got = {r["src_id"]: r["cluster_id"] for r in dedup.clusters(frame, 2.0, "src_id", ["plate_id"]).collect()}
        assert got == {**{f"s{k}": "s0" for k in range(6)}, "far": "far", "other": "other"}
    clustered = dedup.clusters(df, 2.0, "src_id", ["plate_id"])
    reps = {r["cluster_id"]: r["rep_id"] for r in dedup.representatives(clustered, "src_id", F.col("src_id") == "s4").collect()}
    assert reps["s0"] == "s4"
    hit = spark.createDataFrame([("s2", True)], "src_id string, moving boolean")
    assert {r["rep_id"] for r in dedup.flags_of_members(clustered, "src_id", hit, ["moving"]).where("moving").collect()} == {"s0"}
    roots = dedup.plate_components(df.where("plate_id = 'p'").toPandas(), 2.0)
    assert len(set(roots)) == 2


def test_first_values(spark):
    df = spark.createDataFrame([(1, 1, None, "a"), (1, 2, 5, None), (1, 3, 6, "c"), (2, 1, None, None)], "k int, o int, x int, y string")
    assert [tuple(r) for r in dedup.first_values(df, "k", [F.col("o")]).orderBy("k").select("k", "x", "y").collect()] == [(1, 5, "a"), (2, None, None)]


def test_fit_recovers_a_distortion(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(120):
        x, y = rng.uniform(-0.25, 0.25, 2)
        ox, oy = 1e-4 + 2e-4 * x - 1e-4 * x * y, -2e-4 + 1e-4 * y * y
        bad = 0.002 if k % 20 == 0 else 0.0
        rows.append(("t", 359.9, 10.0, float((359.9 + x) % 360), float(10 + y), float((359.9 + x + ox + bad) % 360), float(10 + y + oy)))
    df = spark.createDataFrame(rows, "tile_id string, ra0 double, dec0 double, ra double, dec double, ra_ref double, dec_ref double")
    solution = fit.fits(df)
    row = solution.first()
    assert row["ok"] and row["dropped"] == 6
    fixed = fit.apply_fit(df, solution).toPandas()
    good = [k for k in range(120) if k % 20]
    assert np.abs((fixed.RA_corr - fixed.ra_ref + 180) % 360 - 180)[good].max() < 1e-6 and np.abs(fixed.Dec_corr - fixed.dec_ref)[good].max() < 1e-6
    few = fit.fits(df.limit(5)).first()
    assert not few["ok"] and fit.apply_fit(df, fit.fits(df.limit(5))).where("RA_corr IS NULL").count() == 120


def test_masks(spark):
    df = spark.createDataFrame([(1, True, False), (2, False, True), (3, None, None)], "id int, a boolean, b boolean")
    names = {"a": "a", "b": "b"}
    pick = lambda m: [r["id"] for r in df.where(flags.mask(m, names)).collect()]
    assert pick("exclude_a and exclude_b") == [3] and pick("exclude_a or not exclude_b") == [2, 3] and pick("not (exclude_a)") == [1]
    for bad in ("exclude_c", "exclude_a; drop", "exclude_a and", "(exclude_a", "exclude_a exclude_b", "1=1"):
        with pytest.raises(flags.MaskError):
            flags.mask(bad, names)


def test_union_never_multiplies(spark):
    base = spark.createDataFrame([("t:1", 1), ("u:1", 1), ("t:2", 2)], "row_id string, NUMBER int")
    side = spark.createDataFrame([(1, "True"), (1, "0"), (1, "1")], "NUMBER int, ptf string")
    out = flags.masked_union(base, {"ptf": (side, "NUMBER")})
    assert sorted((r["row_id"], r["ptf"]) for r in out.collect()) == [("t:1", True), ("t:2", False), ("u:1", True)]
    assert flags.unmatched(base, base.limit(0)).count() == 3


def test_lookup_chain_is_checked(spark):
    rows = spark.createDataFrame([("a", "t1")], "src_id string, tile_id string")
    tiles = spark.createDataFrame([("t1", "p1"), ("t1", "p2")], "tile_id string, plate_id string")
    epochs = spark.createDataFrame([("p1", "1950-01-01", 1.0)], "plate_id string, date_obs_iso string, jd double")
    with pytest.raises(plates.LookupFault):
        plates.epoch_chain(rows, tiles, epochs)
    assert plates.epoch_chain(rows, tiles.limit(1), epochs).first()["epoch_jd"] == 1.0
    with pytest.raises(plates.LookupFault):
        plates.epoch_chain(rows, tiles.where("plate_id = 'p2'"), epochs)


def test_stage_laws(spark):
    rows = spark.createDataFrame([(f"s{k}", 10.0 + k / 100, float(k % 3 - 1)) for k in range(60)], "src_id string, ra double, dec double")
    cat = rows.where("src_id < 's3'").selectExpr("src_id AS objID", "ra + 0.0001 AS ra", "dec")
    r = stages.ps1_stage(rows, cat)
    assert r.flags.count() == 60 and r.ledger()["totals"]["n_in"] == 60
    assert r.kept.count() == r.ledger()["totals"]["n_kept"] and r.kept.columns == rows.columns
    keep, drop = (stages.scos_stage(rows, cat, mode=m).kept.count() for m in ("keep_matches", "drop_matches"))
    assert keep + drop == 60
    survivors, account = stages.cascade(rows, [("one", cat), ("empty", cat.limit(0))])
    lines = {x["veto"]: x for x in account.collect()}
    assert lines["empty"]["n_eliminated"] == 0 and lines["one"]["n_after"] == survivors.count()
    assert stages.veto(rows, cat, enabled=False)[1].count() == 60


def test_funnel_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k}", 10.0 + k / 100, 1.0) for k in range(10)], "src_id string, ra double, dec double")
    calls = []

    def stage(df):
        calls.append(1)
        return stages.scos_stage(df, rows.limit(3))

    funnel = stages.Funnel([("scos", stage)])
    assert funnel.write(rows, str(tmp_path))["scos"]["totals"]["n_kept"] == 3
    assert funnel.write(rows, str(tmp_path)) == {} and calls == [1]


def test_moving_objects(spark):
    rows = spark.createDataFrame([("a", 10.0, 0.0, "p"), ("b", 10.01, 0.0, "p"), ("c", 50.0, 0.0, "p"), ("d", 10.0, 0.0, "q")], "src_id string, ra double, dec double, plate_id string").withColumns({"epoch_iso": F.lit("1950"), "epoch_jd": F.lit(1.0)})
    named, centres = stages.fields(rows)
    field = {r["src_id"]: r["field_id"] for r in named.collect()}
    assert field["a"] == field["b"] != field["d"] and centres.count() == 3
    objects = spark.createDataFrame([(field["a"], 10.0005, 0.0)], "field_id string, ra_o double, dec_o double")
    got = {r["src_id"]: (r["has_skybot_match"], r["wide_skybot_match"], r["matched_count"]) for r in stages.skybot_stage(rows, objects).flags.collect()}
    assert got == {"a": (True, False, 1), "b": (False, True, 1), "c": (False, False, 0), "d": (False, False, 0)}
    back = stages.skybot_stage(rows, objects, fallback=spark.createDataFrame([(50.0, 0.0)], "ra double, dec double"), cap=5)
    assert back.flags.where("src_id = 'c'").first()["has_skybot_match"]


def test_overlapping_tiles_meet_near_the_pole_and_over_zero(spark):
    a = spark.createDataFrame([(1, 10.0, 89.7), (2, 0.1, 5.0), (3, 200.0, -89.9), (4, None, 0.0)], "id long, ra double, dec double")
    b = spark.createDataFrame([(1, 70.0, 89.7), (2, 359.9, 5.2), (3, 20.0, -89.9), (4, 0.4, 5.4), (5, 1.0, 5.0)], "id long, ra double, dec double")
    wanted = set()
    for x in a.where("ra IS NOT NULL").collect():
        for y in b.collect():
            gap = abs((x["ra"] - y["ra"] + 180) % 360 - 180) * math.cos(math.radians((x["dec"] + y["dec"]) / 2))
            if max(0.0, 0.5 - gap) * max(0.0, 0.5 - abs(x["dec"] - y["dec"])) / 0.25 >= 0.05:
                wanted.add((x["id"], y["id"]))
    assert (1, 1) in wanted and (2, 2) in wanted
    for left, right, turn in ((a, b, 1), (b, a, -1)):
        assert {(r["id"], r["id_b"])[::turn] for r in plates.overlapping_tiles(left, right, 0.5, 0.05).collect()} == wanted


def test_flag_tables_of_one_key_are_one_join(spark):
    base = spark.range(6).selectExpr("id", "id % 2 AS n")
    side = lambda name, k: base.where(f"id % {k} = 0").selectExpr("id", "n", f"'yes' AS {name}")
    out = flags.masked_union(base, {"a": (side("a", 2), "id"), "b": (side("b", 3), "n"), "c": (side("c", 5), "id")})
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(k, k % 2, k % 2 == 0, True, k % 5 == 0) for k in range(6)]


def test_manifest_groups_linked_rows_only(spark):
    """Ids are made unique once in the manifest's plan; a cluster over tiles keeps its core member, a row without a number its tile's core."""
    from skysieve.plans import stages

    near = 0.1 / 3600
    rows = [("t:1", "5", 10.0, 0.0, 1), ("t:2", "5", 10.0 + near, 0.0, 1), ("t:2", "6", 10.0, 0.0, 2), ("t:1", "9", 10.0, near, 1), ("t:2", None, 50.0, 1.0, 1), ("t:3", "1", 70.0, 1.0, 1), ("t:2", "5", 11.0, 0.0, 1)]
    tiles = spark.createDataFrame(rows, "tile_id string, object_id string, ra double, dec double, plate_id int")
    edge = spark.createDataFrame([("t:1", "near_edge", "edge"), ("t:2", "core", "edge")], "tile_id string, class_px string, class_arcsec string")
    made = stages.build_candidates(tiles, eligible=spark.createDataFrame([("t:1",), ("t:2",)], "tile_id string"), edge=edge)
    assert {r["src_id"]: r["is_core"] for r in made["all"].collect()} == {"t:2:5": True, "t:2:6": True}
    assert {r["src_id"]: r["cluster_id"] for r in made["members"].collect()} == {"t:1:5": "t:1:5", "t:2:5": "t:1:5", "t:1:9": "t:1:5", "t:2:6": "t:2:6", None: None}
    assert {tuple(r[c] for c in ("tile_id", "n_emitted", "n_rows", "n_kept", "n_core")) for r in made["manifest"].collect()} == {("t:1", 2, 2, 0, 0), ("t:2", 4, 3, 2, 3)}
    assert made["manifest"]._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    alone = stages.build_candidates(tiles, eligible=spark.createDataFrame([], "tile_id string"))
    assert {r["src_id"] for r in alone["stage"].collect()} == {"t:1:5", "t:2:6", "t:3:1"}


def test_tile_lists_move_no_rows(spark, monkeypatch):
    """Lists of tiles are broadcast up to a number of tiles, and joined with the same result beyond it."""
    from skysieve.plans import stages

    tiles = spark.createDataFrame([(f"t{k % 3}", str(k), k * 1.0, 0.0, 1) for k in range(9)], "tile_id string, object_id string, ra double, dec double, plate_id int")
    eligible, edge = spark.createDataFrame([("t0",), ("t0",), ("t1",)], "tile_id string"), spark.createDataFrame([("t1", "core", "edge")], "tile_id string, class_px string, class_arcsec string")
    run = lambda: stages.build_candidates(tiles, eligible=eligible, edge=edge)["all"]
    few = run()
    assert few._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2
    monkeypatch.setattr(stages, "FEW_TILES", 1)
    many = run()
    assert many._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert [(r["tile_id"], r["is_core"]) for r in few.select("tile_id", "is_core").distinct().orderBy("tile_id").collect()] == [("t0", False), ("t1", True)]


def test_flag_stage_joins_rows_once(spark):
    """Rows meet their matches in one join whatever the catalogues, and keys that repeat don't multiply them."""
    from skysieve.plans import stages

    rows = spark.createDataFrame([("a", 10.0, 0.0), ("a", 10.0, 0.0), ("b", 20.0, 0.0), ("c", 30.0, 0.0), (None, 10.0, 0.0)], "src_id string, ra double, dec double")
    sky_a = spark.createDataFrame([(10.0, 0.0), (10.0, 0.0001)], "ra double, dec double")
    sky_b = spark.createDataFrame([(10.0, 0.0), (20.0, 0.0)], "ra double, dec double")
    flags = stages.flag_stage(rows, {"a": sky_a, "b": sky_b}).flags
    assert flags.columns == ["src_id", "ra", "dec", "has_a_match", "has_b_match", "any_match"]
    got = sorted((r["src_id"] or "", r["has_a_match"], r["has_b_match"], r["any_match"]) for r in flags.collect())
    assert got == [("", False, False, False), ("a", True, True, True), ("a", True, True, True), ("b", False, True, True), ("c", False, False, False)]
    assert flags._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    assert stages.flag_stage(rows, {}).flags.where("any_match").count() == 0


def test_manifest_makes_only_crowded_rows_unique(spark, monkeypatch):
    """Rows alone in their cells reach neither the sky join nor the grouping; lists of keys too long to be broadcast give the same."""
    from skysieve.plans import stages

    near = 0.1 / 3600
    lone = [(f"t{k % 3}", k, k * 1.0, k * 0.5, k % 2) for k in range(60)]
    rows = lone + [("t0", 100, 5.0, 2.5 + near, 1), ("t1", 101, 5.0, 2.5 - near, 1), ("t0", 102, 7.0, 3.5, 0), ("t1", 103, 9.0, 80.0, 1), ("t1", 103, 9.0, 4.5, 1)]
    tiles = spark.createDataFrame(rows, "tile_id string, object_id bigint, ra double, dec double, plate_id int")
    seen, links = [], dedup.links
    monkeypatch.setattr(dedup, "links", lambda df, *a: seen.append({r["src_id"] for r in df.collect()}) or links(df, *a))
    made = stages.build_candidates(tiles)
    # beside 9 lies the first row of 103; 7 and 102 are of two plates
    assert seen == [{"t0:9", "t1:103", "t2:5", "t0:100", "t1:101"}]
    linked = {r["src_id"]: r["cluster_id"] for r in made["members"].collect() if r["src_id"] != r["cluster_id"]}
    assert linked == {"t1:101": "t0:100", "t2:5": "t0:100", "t1:103": "t0:9"}
    want = [("t0", 22, 22, 22, 22), ("t1", 22, 20, 22, 23), ("t2", 20, 19, 20, 20)]
    got = lambda d: sorted(tuple(r[c] for c in ("tile_id", "n_rows", "n_kept", "n_core", "n_emitted")) for r in d.collect())
    assert got(made["manifest"]) == want
    monkeypatch.setattr(dedup, "FEW_KEYS", 0)
    assert got(stages.build_candidates(tiles)["manifest"]) == want and seen[1] == seen[0]


def test_crowded_rows_hold_every_link(spark):
    """Both ends of every pair within the tolerance are crowded: on cell edges, over RA 0, at the poles; a lone row isn't."""
    rng = np.random.default_rng(5)
    n = 1500
    dec = np.r_[rng.uniform(-0.003, 0.003, n), rng.uniform(89.9992, 90, n), rng.uniform(-90, -89.9992, n)]
    ra = np.r_[rng.uniform(-0.003, 0.003, n) % 360, rng.uniform(0, 360, 2 * n)]
    df = spark.createDataFrame([(k, float(ra[k]), float(dec[k]), k % 3) for k in range(3 * n)] + [(-1, 100.0, 45.0, 0), (-2, float("nan"), 45.0, 0)], "id long, ra double, dec double, plate int").cache()
    for tol in (0.25, 2.0):
        ends = {k for r in dedup.cluster_pairs(df, tol, "id", ["plate"]).collect() for k in r}
        met = {r["id"] for r in dedup.crowded(df, tol, ["plate"]).collect()}
        assert len(ends) > 50 and ends <= met and not met & {-1, -2}
