"""Queries of filters, flags, keys, epochs and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.functions import sky, text
from skysieve.operators import dedup, filters, flags
from skysieve.plans import master, qc, stages
from skysieve.plans.derived import catalogue, cte, detections, frames, read, sep
from skysieve.session import cut
from skysieve.sources.tables import numbered

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_EXTRACT = "FLAGS = 0 AND isfinite(SNR_WIN) AND SNR_WIN > 30"
_SHAPE = "isfinite(SPREAD_MODEL) AND SPREAD_MODEL > -0.002 AND isfinite(FWHM_IMAGE) AND FWHM_IMAGE > 2 AND FWHM_IMAGE < 7 AND ELONGATION < 1.3 AND XMAX_IMAGE - XMIN_IMAGE > 1 AND YMAX_IMAGE - YMIN_IMAGE > 1 AND abs((XMAX_IMAGE - XMIN_IMAGE) - (YMAX_IMAGE - YMIN_IMAGE)) < 2"


def _bounds(source: str, group: str = "tile_id") -> str:
    """CTEs m and z of the clip bounds over a source."""
    x = {c: f"CASE WHEN isfinite({c}) THEN {c} END" for c in ("FWHM_IMAGE", "ELONGATION")}
    med = ", ".join(f"median({v}) AS m_{c}" for c, v in x.items())
    mad = ", ".join(f"median(abs({v} - m_{c})) * 1.4826E0 AS s_{c}, any_value(m_{c}) AS m_{c}" for c, v in x.items())
    return f"m AS (SELECT {group}, {med} FROM {source} GROUP BY 1), z AS (SELECT {group}, {mad} FROM {source} JOIN m USING ({group}) GROUP BY 1)"


def _inside(c: str) -> str:
    return f"(isfinite({c}) AND (coalesce(NOT s_{c} > 0, TRUE) OR abs({c} - m_{c}) <= 2.0E0 * s_{c}))"


@query(cte("det") + f" SELECT src_id, SNR_WIN FROM det WHERE {_EXTRACT}")
def extract_gate(spark, d):
    return filters.extract_gate(detections(spark, d)).select("src_id", "SNR_WIN")


@query(cte("det") + f", {_bounds('det')} SELECT src_id FROM det JOIN z USING (tile_id) WHERE {_inside('FWHM_IMAGE')}")
def robust_sigma_clip(spark, d):
    return filters.robust_clip(detections(spark, d).select("src_id", "tile_id", "FWHM_IMAGE", "ELONGATION"), ["FWHM_IMAGE"], ["tile_id"]).select("src_id")


@query(cte("det") + f", e AS (SELECT * FROM det WHERE {_EXTRACT}), {_bounds('e')} SELECT src_id FROM e JOIN z USING (tile_id) WHERE {_inside('FWHM_IMAGE')} AND {_inside('ELONGATION')} AND {_SHAPE}")
def morphology_filter(spark, d):
    return filters.morphology(filters.extract_gate(detections(spark, d)), ["tile_id"]).select("src_id")


_REASONS = cte("det") + f""", e AS (SELECT * FROM det WHERE {_EXTRACT}), {_bounds('e')},
r AS (SELECT src_id, [CASE WHEN NOT FLAGS = 0 THEN 'flags' END, CASE WHEN NOT (isfinite(SNR_WIN) AND SNR_WIN > 30) THEN 'snr' END] AS x,
 [CASE WHEN NOT {_inside('FWHM_IMAGE')} THEN 'sigma_clip_fwhm' END, CASE WHEN NOT {_inside('ELONGATION')} THEN 'sigma_clip_elongation' END, CASE WHEN NOT SPREAD_MODEL > -0.002 THEN 'spread_model' END,
  CASE WHEN NOT (isfinite(FWHM_IMAGE) AND FWHM_IMAGE > 2 AND FWHM_IMAGE < 7) THEN 'fwhm' END, CASE WHEN NOT ELONGATION < 1.3 THEN 'elongation' END,
  CASE WHEN NOT (XMAX_IMAGE > 1 AND YMAX_IMAGE > 1) THEN 'extent_min' END, CASE WHEN NOT abs(XMAX_IMAGE - YMAX_IMAGE) < 2 THEN 'extent_delta' END] AS y FROM det LEFT JOIN z USING (tile_id)),
q AS (SELECT src_id, array_to_string(list_filter(x, lambda v: v IS NOT NULL), '|') AS x, array_to_string(list_filter(y, lambda v: v IS NOT NULL), '|') AS y FROM r),
o AS (SELECT src_id, CASE WHEN x <> '' THEN 'extract' WHEN y <> '' THEN 'morphology' END AS reject_stage, CASE WHEN x <> '' THEN x WHEN y <> '' THEN y END AS reject_reason FROM q)"""


@query(_REASONS + " SELECT * FROM o")
def reject_reasons(spark, d):
    return filters.reject_reasons(detections(spark, d), ["tile_id"]).select("src_id", "reject_stage", "reject_reason")


@query(_REASONS + ", t AS (SELECT unnest(string_split(coalesce(reject_reason, 'kept'), '|')) AS reason FROM o) SELECT reason, count(*) AS n FROM t GROUP BY 1")
def reject_tallies(spark, d):
    return filters.reason_tallies(filters.reject_reasons(detections(spark, d), ["tile_id"]))


@query(cte("frames") + " SELECT event_id FROM frames WHERE isfinite(dist_arcsec) AND CASE WHEN dist_arcsec > 0.1 THEN dist_arcsec ELSE dist_arcsec * 3600.0E0 END <= 5")
def within5_unit_tolerant(spark, d):
    return filters.within_arcsec(frames(spark, d), "dist_arcsec", 5.0, "guess").select("event_id")


@query(cte("frames") + " SELECT event_id, mjd FROM frames WHERE qual_frame > 0 AND qi_fact > 0 AND saa_sep > 0 AND isfinite(w1snr) AND w1snr >= 5 AND mjd <= 59198.0 AND lpad(regexp_replace(moon_masked, '[^0-9]', '', 'g'), 2, '0') = '00'")
def neowise_gates(spark, d):
    return filters.neowise_gate(frames(spark, d)).select("event_id", "mjd")


@query(cte("det") + ", r AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY ra, dec) AS n FROM det) SELECT src_id, tile_id, ra, dec FROM r WHERE n = 1")
def first_per_src(spark, d):
    return dedup.first_by(detections(spark, d).select("src_id", "tile_id", "ra", "dec"), ["src_id"], [F.col("ra"), F.col("dec")])


@query(cte("frames") + ", r AS (SELECT user_id, first_value(CASE WHEN isfinite(w1snr) THEN w1snr END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY dist_arcsec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS w1snr, dist_arcsec, row_number() OVER (PARTITION BY user_id ORDER BY dist_arcsec, event_id) AS n FROM frames) SELECT user_id, w1snr, dist_arcsec FROM r WHERE n = 1")
def closest_per_row(spark, d):
    rows = frames(spark, d).select("user_id", F.when(sky.finite("w1snr"), F.col("w1snr")).alias("w1snr"), "dist_arcsec", "event_id")
    return dedup.first_values(rows, "user_id", [F.col("dist_arcsec"), F.col("event_id")]).select("user_id", "w1snr", "dist_arcsec")


@query(cte("det") + ", c AS (SELECT plate_no, tile_id, count(*) AS n FROM det GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY plate_no ORDER BY n DESC, tile_id) AS k FROM c) SELECT plate_no, tile_id, n FROM r WHERE k = 1")
def majority_tile(spark, d):
    return dedup.majority(detections(spark, d), "plate_no", "tile_id")


@query(cte("frames") + " SELECT user_id, bool_or(dist_arcsec <= 2.0) AS has_ir_match, min(dist_arcsec) AS dist_arcsec FROM frames GROUP BY 1")
def sidecar_collapse(spark, d):
    return flags.collapse(frames(spark, d).withColumn("has_ir_match", F.col("dist_arcsec") <= 2.0), "user_id")


_SIDES = {"has_vosa_like_match": ("src_id", 7), "is_supercosmos_artifact": ("src_id", 5), "ptf_match_ngood": ("number", 11), "is_known_variable_or_transient": ("number", 13), "skybot_strict": ("src_id", 17)}


def _union(spark, d):
    rows = detections(spark, d)
    base = rows.select("src_id", "number", "tile_id", "ra", "dec")
    slim = rows.select("src_id", "number", (F.col("number") + F.col("plate_no")).alias("k"))
    return flags.masked_union(base, {n: (slim.where(F.col("k") % m == 0).select(key, F.lit("True").alias(n)), key) for n, (key, m) in _SIDES.items()})


_UNION = cte("det") + ", s AS (SELECT src_id, number, number + plate_no AS k FROM det), u AS (SELECT src_id, number, tile_id, ra, dec, " + ", ".join(f"{k} IN (SELECT {k} FROM s WHERE k % {m} = 0) AS {n}" for n, (k, m) in _SIDES.items()) + " FROM det)"
_KEPT = " AND ".join(f"NOT {n}" for n in _SIDES)


@query(_UNION + " SELECT * FROM u")
def masked_union(spark, d):
    return _union(spark, d)


@query(_UNION + " SELECT count(*) AS masked_rows, " + ", ".join(f"count(*) FILTER (WHERE {n}) AS {n}_rows" for n in _SIDES) + f", count(*) FILTER (WHERE {_KEPT.rpartition(' AND ')[0]}) AS remainder_without_last, count(*) FILTER (WHERE {_KEPT}) AS remainder_with_all FROM u")
def gate_tallies(spark, d):
    return flags.gate_tallies(_union(spark, d))


@query(_UNION + f" SELECT src_id, number, tile_id FROM u WHERE {_KEPT}")
def remainder_inclusive(spark, d):
    return flags.remainder(_union(spark, d)).select("src_id", "number", "tile_id")


_EDGE = "SELECT DISTINCT tile_id, CASE WHEN CAST(substr(tile_id, 6) AS INTEGER) % 3 = 0 THEN 'core' ELSE 'near_edge' END AS class_px, CASE WHEN CAST(substr(tile_id, 6) AS INTEGER) % 5 = 0 THEN 'Core' END AS class_arcsec FROM det"


@query(_UNION + f", e AS ({_EDGE}) SELECT src_id, tile_id FROM u WHERE {_KEPT} AND tile_id IN (SELECT tile_id FROM e WHERE lower(coalesce(class_px, '')) = 'core' OR lower(coalesce(class_arcsec, '')) = 'core')")
def remainder_core(spark, d):
    n = F.substring("tile_id", 6, 9).cast("int")
    edge = detections(spark, d).select("tile_id", F.when(n % 3 == 0, "core").otherwise("near_edge").alias("class_px"), F.when(n % 5 == 0, "Core").alias("class_arcsec")).distinct()
    return flags.core_only(flags.remainder(_union(spark, d)), edge).select("src_id", "tile_id")


_MASK = "exclude_vosa and (exclude_ptf or not exclude_scos)"


@query(_UNION + " SELECT src_id, tile_id FROM u WHERE NOT has_vosa_like_match AND (NOT ptf_match_ngood OR is_supercosmos_artifact)")
def mask_expression_export(spark, d):
    names = {"vosa": "has_vosa_like_match", "ptf": "ptf_match_ngood", "scos": "is_supercosmos_artifact"}
    union = _union(spark, d)
    keys = union.where(flags.mask(_MASK, names)).select("src_id", "number")
    return union.join(keys.distinct(), ["src_id", "number"], "left_semi").select("src_id", "tile_id")


_CELL = 0.5 / 3600.0


@query(cte("det") + f", i AS (SELECT DISTINCT tile_id, number FROM det WHERE number % 4 = 0), h AS (SELECT tile_id, number, number % 3 = 0 AS exclude_hpm, number % 5 = 0 AS exclude_edge FROM det), "
       f"g AS (SELECT tile_id, number, row_number() OVER (PARTITION BY round(ra / {_CELL!r}), round(dec / {_CELL!r}) ORDER BY tile_id, number) AS n FROM det), "
       "j AS (SELECT g.tile_id, g.number, i.number IS NOT NULL AS ir, g.number % 3 = 0 AS hpm, g.number % 5 = 0 AS edge FROM g LEFT JOIN i ON i.tile_id = g.tile_id AND i.number = g.number WHERE n = 1) "
       "SELECT count(*) AS n_total, count(*) FILTER (WHERE ir) AS n_ir, count(*) FILTER (WHERE hpm) AS n_hpm, count(*) FILTER (WHERE edge) AS n_edge, count(*) - count(*) FILTER (WHERE ir) - count(*) FILTER (WHERE hpm) - count(*) FILTER (WHERE edge) AS survivors_by_sums, count(*) FILTER (WHERE NOT ir AND NOT hpm AND NOT edge) AS survivors FROM j")
def composite_left_counts(spark, d):
    rows = detections(spark, d).select("tile_id", "number", "ra", "dec")
    one = dedup.grid_first(rows, 0.5, [F.col("tile_id"), F.col("number")])
    ir = rows.where("number % 4 = 0").select("tile_id", "number").distinct().withColumn("ir", F.lit(True))
    both = one.join(ir, ["tile_id", "number"], "left").select(F.coalesce("ir", F.lit(False)).alias("ir"), (F.col("number") % 3 == 0).alias("hpm"), (F.col("number") % 5 == 0).alias("edge"))
    n = [F.count_if(F.col(c)) for c in ("ir", "hpm", "edge")]
    return both.agg(F.count("*").alias("n_total"), *[x.alias(f"n_{c}") for x, c in zip(n, ("ir", "hpm", "edge"), strict=True)], (F.count("*") - n[0] - n[1] - n[2]).alias("survivors_by_sums"), F.count_if(~F.col("ir") & ~F.col("hpm") & ~F.col("edge")).alias("survivors"))


def _compared(spark, d):
    rows = frames(spark, d)
    a, b = rows.where("event_id % 7 <> 0"), rows.where("event_id % 5 <> 0").withColumn("mjd", F.col("mjd") + F.when(F.col("event_id") % 3 == 0, F.lit(0.001)).otherwise(F.lit(0.00001)))
    return flags.compare(a, b, ["event_id"], {"mjd": (5e-5, 0.0), "dist_arcsec": (0.1, 0.0)})


_COMPARE = cte("frames") + ", a AS (SELECT event_id, mjd FROM frames WHERE event_id % 7 <> 0), b AS (SELECT event_id, mjd + CASE WHEN event_id % 3 = 0 THEN 0.001E0 ELSE 0.00001E0 END AS mjd FROM frames WHERE event_id % 5 <> 0), c AS (SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'right_only' WHEN b.event_id IS NULL THEN 'left_only' ELSE 'both' END AS side, abs(a.mjd - b.mjd) <= 5e-5 AS agree FROM a FULL JOIN b ON a.event_id = b.event_id)"


@query(_COMPARE + " SELECT count(*) FILTER (WHERE side = 'both') AS overlap, count(*) FILTER (WHERE agree) AS n_match, count(*) FILTER (WHERE NOT agree) AS n_mismatch, count(*) FILTER (WHERE side = 'right_only') AS missing_left, count(*) FILTER (WHERE side = 'left_only') AS missing_right FROM c")
def comparator_overlap(spark, d):
    return flags.comparison_summary(_compared(spark, d))


@query(_COMPARE + " SELECT event_id, side FROM c WHERE side <> 'both'")
def missing_each_side(spark, d):
    return _compared(spark, d).where("side <> 'both'").select("event_id", "side")


@query(_COMPARE + ", f AS (SELECT c.event_id, frames.* EXCLUDE (event_id) FROM c JOIN frames USING (event_id) WHERE side = 'right_only') SELECT event_id, CASE WHEN NOT mjd BETWEEN 59010.0 AND 59190.0 THEN 'outside_box' WHEN NOT qual_frame > 0 THEN 'quality' WHEN NOT coalesce(isfinite(w1snr) AND w1snr >= 5, FALSE) THEN 'signal' ELSE 'unexplained' END AS why FROM f")
def missing_explained(spark, d):
    missing = _compared(spark, d).where("side = 'right_only'").select("event_id").join(frames(spark, d), "event_id")
    gates = {"quality": F.col("qual_frame") > 0, "signal": sky.finite("w1snr") & (F.col("w1snr") >= 5)}
    return flags.explain_missing(missing, F.col("mjd").between(59010.0, 59190.0), gates).select("event_id", "why")


@query(_UNION + " SELECT count(*) AS n_rows, count(DISTINCT src_id) AS n_keys, count(DISTINCT CASE WHEN ptf_match_ngood THEN src_id END) AS n_ptf_match_ngood, count(DISTINCT CASE WHEN skybot_strict THEN src_id END) AS n_skybot_strict FROM u")
def flag_snapshot_distinct(spark, d):
    return qc.snapshot(_union(spark, d), "src_id", ["ptf_match_ngood", "skybot_strict"])


@query(cte("frames") + " SELECT qual_frame, count(w) AS n, min(w) AS min, max(w) AS max, round(avg(w), 6) AS mean, quantile_cont(w, 0.5) AS p50, round(quantile_cont(w, 0.9), 6) AS p90, round(quantile_cont(w, 0.95), 6) AS p95 FROM (SELECT qual_frame, CASE WHEN isfinite(w1snr) THEN w1snr END AS w FROM frames) GROUP BY 1")
def qc_chunk(spark, d):
    return qc.distances(frames(spark, d), "w1snr", ["qual_frame"]).withColumns({c: F.round(c, 6) for c in ("mean", "p90", "p95")})


@query(cte("frames") + " SELECT count(*) AS n_rows, count(*) FILTER (WHERE dist_arcsec <= 2.0) AS n_strict, round(100.0E0 * count(*) FILTER (WHERE dist_arcsec <= 2.0) / count(*), 2) AS pct_strict, count(*) FILTER (WHERE w1snr >= 20) AS snr_20_up, count(*) FILTER (WHERE w1snr >= 10 AND w1snr < 20) AS snr_10_20, count(*) FILTER (WHERE w1snr < 10) AS snr_under_10, count(*) FILTER (WHERE qual_frame > 0) AS n_good_frames, min(mjd) AS first_mjd, max(mjd) AS last_mjd, count(DISTINCT (user_id % 72, event_id % 36)) AS n_bins FROM frames")
def qc_global(spark, d):
    rows = frames(spark, d).withColumns({"ra_bin": F.col("user_id") % 72, "dec_bin": F.col("event_id") % 36})
    return qc.global_summary(rows, filters.strict_match(rows, 2.0))


_TILESTATS = cte("det") + f", e AS (SELECT tile_id, count(*) AS detected, count(*) FILTER (WHERE {_EXTRACT}) AS extracted, count(*) FILTER (WHERE {_EXTRACT} AND {_SHAPE}) AS shaped, median(CASE WHEN isfinite(FWHM_IMAGE) THEN FWHM_IMAGE END) AS fwhm FROM det GROUP BY 1)"


def _tiles(spark, d):
    rows = detections(spark, d)
    gate = filters.every(F.col("FLAGS") == 0, sky.finite("SNR_WIN"), F.col("SNR_WIN") > 30)
    shape = filters.every(*filters.morphology_rules(rows, clip=False).values())
    return rows.groupBy("tile_id").agg(F.count("*").alias("detected"), F.count_if(gate).alias("extracted"), F.count_if(gate & shape).alias("shaped"), F.median(F.when(sky.finite("FWHM_IMAGE"), F.col("FWHM_IMAGE"))).alias("fwhm"))


@query(_TILESTATS + " SELECT count(*) AS n_tiles, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(extracted) AS BIGINT) AS extracted, CAST(sum(shaped) AS BIGINT) AS shaped, round(100.0E0 * sum(extracted) / sum(detected), 2) AS pct_extracted, round(100.0E0 * sum(shaped) / sum(detected), 2) AS pct_shaped FROM e")
def run_summary_pct(spark, d):
    return qc.run_summary(_tiles(spark, d), ["detected", "extracted", "shaped"])


@query(_TILESTATS + ", s AS (SELECT unnest(['all', CASE WHEN CAST(substr(tile_id, 6) AS INTEGER) % 4 <> 0 THEN 'eligible' ELSE 'excluded' END]) AS scope, CAST(CASE WHEN shaped > 0 THEN shaped WHEN extracted > 0 THEN extracted ELSE 0 END AS DOUBLE) AS v FROM e) SELECT scope, count(v) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS p50, round(quantile_cont(v, 0.9), 6) AS p90 FROM s GROUP BY 1")
def stage_stats_scopes(spark, d):
    tiles = _tiles(spark, d).withColumn("late", qc.late_survivors("shaped", "extracted").cast("double"))
    return qc.stage_stats(tiles, "late", F.substring("tile_id", 6, 9).cast("int") % 4 != 0).withColumns({c: F.round(c, 6) for c in ("mean", "p90")})


@query("WITH t AS (SELECT ((c_custkey * 7919) % 29) / 10.0E0 AS ra, ((c_custkey * 104729) % 23) / 10.0E0 AS dec FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey % 29 = 0) SELECT round(ra, 3) AS ra, round(dec, 3) AS dec, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_centres(spark, d):
    return qc.duplicate_centres(read(spark, d, "customer").where("c_custkey % 11 <> 0 OR c_custkey % 29 = 0").selectExpr("((c_custkey * 7919) % 29) / 10.0E0 AS ra", "((c_custkey * 104729) % 23) / 10.0E0 AS dec"))


@query(_TILESTATS + " SELECT tile_id, fwhm FROM e WHERE isfinite(fwhm) ORDER BY fwhm DESC, tile_id LIMIT 10")
def top10_tiles(spark, d):
    return qc.top(_tiles(spark, d), "fwhm").select("tile_id", "fwhm")


@query("WITH s AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'COMPLETED' WHEN o_orderkey % 5 = 0 THEN 'PARTIAL' WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'PARTIAL' WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'O' THEN 'NEED_RESUBMIT' WHEN o_orderkey % 3 = 0 THEN 'IN_FLIGHT' ELSE 'NEW' END AS state FROM orders) SELECT state, count(*) AS n FROM s GROUP BY 1")
def job_state_counts(spark, d):
    o = read(spark, d, "orders")
    phase = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "ERROR").otherwise("EXECUTING")
    k = F.col("o_orderkey")
    return o.select(qc.job_state(k % 7 == 0, k % 5 == 0, k % 3 == 0, phase).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query(cte("any") + ", n AS (SELECT cat_id, CASE WHEN cat_id % 9 = 0 THEN ra + 2 ELSE ra END AS ra, dec, printf('%.3f', floor(ra * 4) / 4) AS a, printf('%+.3f', floor(dec * 4) / 4) AS b FROM any_), t AS (SELECT cat_id, ra, dec, CAST(a AS DOUBLE) AS ra0, CAST(b AS DOUBLE) AS dec0 FROM n), "
       "s AS (SELECT cat_id, degrees(2 * asin(sqrt(least(1.0E0, pow(sin(radians(dec0 - dec) / 2), 2) + cos(radians(dec)) * cos(radians(dec0)) * pow(sin(radians(ra0 - ra) / 2), 2))))) AS s FROM t) SELECT cat_id, round(s, 4) AS sep_deg FROM s WHERE s > 1.5")
def tripwire(spark, d):
    rows = catalogue(spark, d).withColumn("tile_id", text.tile_name(F.floor(F.col("ra") * 4) / 4.0, F.floor(F.col("dec") * 4) / 4.0)).withColumn("ra", F.when(F.col("cat_id") % 9 == 0, F.col("ra") + 2).otherwise(F.col("ra")))
    return qc.tripwire(rows).select("cat_id", F.round("sep_deg", 4).alias("sep_deg"))


@query("SELECT DISTINCT n AS NUMBER FROM (SELECT l_partkey AS n FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_suppkey FROM lineitem WHERE l_tax > 0.05)")
def union_ids_distinct(spark, d):
    rows = read(spark, d, "lineitem")
    return flags.ids_union(rows.where("l_quantity > 45").selectExpr("l_partkey AS NUMBER"), rows.where("l_tax > 0.05").selectExpr("l_suppkey AS NUMBER"), distinct=True)


@query("SELECT p_partkey AS NUMBER, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def id_antijoin(spark, d):
    return flags.unmatched(read(spark, d, "part").selectExpr("p_partkey AS NUMBER", "p_size"), read(spark, d, "lineitem").where("l_quantity > 45").selectExpr("l_partkey AS NUMBER"))


@query("SELECT id AS id, change FROM (SELECT DISTINCT l_partkey AS id, 'removed' AS change FROM lineitem WHERE l_quantity > 48 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07) UNION ALL SELECT DISTINCT l_partkey, 'added' FROM lineitem WHERE l_tax > 0.07 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48))")
def id_set_deltas(spark, d):
    rows = read(spark, d, "lineitem").selectExpr("l_partkey AS id", "l_quantity", "l_tax")
    return flags.id_deltas(rows.where("l_quantity > 48"), rows.where("l_tax > 0.07"), "id")


@query("SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 2000.0) + 1 AS INTEGER) AS chunk FROM orders")
def chunk_numbering(spark, d):
    rows = numbered(read(spark, d, "orders").withColumnRenamed("o_orderkey", "id"), "id", 2_000)
    return rows.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).drop("o_orderdate")


_FILES = "SELECT concat('part-', CAST(p_partkey AS STRING)) AS path, p_size * 10 AS size, p_partkey * 1000 AS mtime_ns FROM part"
_MANIFEST = "SELECT concat('part-', CAST(p_partkey AS STRING)) AS path, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE p_size * 10 END AS size, p_partkey * 1000 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS mtime_ns FROM part WHERE p_partkey % 10 <> 0"


@query(f"WITH f AS ({_FILES}), m AS ({_MANIFEST}) SELECT f.path, f.size, f.mtime_ns, CASE WHEN m.path IS NULL THEN 'new' ELSE 'changed' END AS change FROM f LEFT JOIN m ON f.path = m.path WHERE m.path IS NULL OR f.size <> m.size OR f.mtime_ns <> m.mtime_ns")
def delta_changed_parts(spark, d):
    p = read(spark, d, "part")
    files = p.selectExpr("concat('part-', p_partkey) AS path", "p_size * 10 AS size", "p_partkey * 1000 AS mtime_ns")
    old = p.where("p_partkey % 10 <> 0").selectExpr("concat('part-', p_partkey) AS path", "CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE p_size * 10 END AS size", "p_partkey * 1000 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS mtime_ns")
    return master.changed_parts(files, old)


_STAMP = "strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE ' ' END || printf('%02d:%02d:%02d', CAST(o_orderkey % 24 AS INTEGER), CAST(o_orderkey % 83 AS INTEGER), CAST(o_orderkey % 71 AS INTEGER)) || CASE WHEN o_orderkey % 3 = 0 THEN 'Z' WHEN o_orderkey % 3 = 1 THEN '' ELSE '+02:00' END"
_SECONDS = "(((o_orderkey % 24) * 3600 + (o_orderkey % 83) * 60 + (o_orderkey % 71)) % 86400)"
_UTC = f"(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds({_SECONDS}) - to_seconds(CASE WHEN o_orderkey % 3 = 2 THEN 7200 ELSE 0 END))"


def _stamps(spark, d):
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 2 == 0, "T").otherwise(" "), two(k % 24), F.lit(":"), two(k % 83), F.lit(":"), two(k % 71), F.when(k % 3 == 0, "Z").when(k % 3 == 1, "").otherwise("+02:00"))
    return read(spark, d, "orders").select("o_orderkey", s.alias("stamp"))


@query(f"SELECT o_orderkey, strftime({_UTC}, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS epoch_iso FROM orders")
def epoch_sanitize(spark, d):
    return _stamps(spark, d).select("o_orderkey", text.epoch_iso("stamp").alias("epoch_iso"))


@query(f"SELECT o_orderkey, round(epoch_us({_UTC}) / 86400000000.0E0 + 40587.0E0, 6) AS mjd, round(epoch_us({_UTC}) / 86400000000.0E0 + 40587.0E0 + 2400000.5E0, 6) AS jd FROM orders")
def mjd_jd(spark, d):
    t = text.epoch_timestamp("stamp")
    return _stamps(spark, d).select("o_orderkey", F.round(text.mjd(t), 6).alias("mjd"), F.round(text.jd(t), 6).alias("jd"))


@query("SELECT p_partkey, CAST(p_partkey * 86399 % 86400000 AS DOUBLE) / 1000.0E0 / 240.0E0 AS ra, CAST((p_partkey * 104729) % 324000000 - 162000000 AS DOUBLE) / 1000.0E0 / 3600.0E0 AS dec FROM part")
def maps_scale(spark, d):
    return read(spark, d, "part").select("p_partkey", sky.maps_ra(F.expr("p_partkey * 86399 % 86400000")).alias("ra"), sky.maps_dec(F.expr("(p_partkey * 104729) % 324000000 - 162000000")).alias("dec"))


@query("WITH t AS (SELECT l_orderkey, l_partkey, CASE WHEN l_orderkey % 4 = 0 THEN CAST(l_partkey AS STRING) || '.0' WHEN l_orderkey % 4 = 1 THEN CAST(l_partkey AS STRING) WHEN l_orderkey % 4 = 2 THEN CAST(l_partkey AS STRING) || 'E+3' ELSE 'x' || CAST(l_partkey AS STRING) END AS raw FROM lineitem) SELECT DISTINCT raw, CASE WHEN l_orderkey % 4 IN (0, 1) THEN CAST(l_partkey AS STRING) WHEN l_orderkey % 4 = 2 THEN CAST(l_partkey * 1000 AS STRING) END AS id FROM t")
def canonical_row_id(spark, d):
    p, k = F.col("l_partkey").cast("string"), F.col("l_orderkey") % 4
    raw = F.when(k == 0, F.concat(p, F.lit(".0"))).when(k == 1, p).when(k == 2, F.concat(p, F.lit("E+3"))).otherwise(F.concat(F.lit("x"), p))
    return read(spark, d, "lineitem").select(raw.alias("raw")).distinct().select("raw", text.canonical_id("raw").alias("id"))


@query(cte("det") + ", b AS (SELECT tile_id, min(ra) AS ra, count(*) AS n FROM det GROUP BY 1) SELECT tile_id, n, CAST(('0x' || substr(sha1(tile_id || ':' || CAST(n AS STRING)), 1, 16)) AS UBIGINT)::STRING AS row_id FROM b")
def stable_row_ids(spark, d):
    return detections(spark, d).groupBy("tile_id").agg(F.count("*").alias("n")).select("tile_id", "n", text.stable_row_id("tile_id", "n").alias("row_id"))


@query("WITH h AS (SELECT s_suppkey % 60 AS plate_id, s_suppkey AS file, s_suppkey % 3 <> 0 AS held FROM supplier), c AS (SELECT c_custkey % 60 AS plate_id FROM customer) SELECT plate_id, count(*) AS n FROM c WHERE plate_id NOT IN (SELECT plate_id FROM h WHERE held) GROUP BY 1")
def missing_plates(spark, d):
    from skysieve.operators.plates import missing_plates as missing

    held = read(spark, d, "supplier").where("s_suppkey % 3 <> 0").selectExpr("s_suppkey % 60 AS plate_id")
    return missing(read(spark, d, "customer").selectExpr("c_custkey % 60 AS plate_id"), held)


@query(cte("det") + ", o AS (SELECT tile_id, src_id, CASE WHEN number % 3 = 0 THEN '' WHEN number % 3 = 1 THEN 'XE' || CAST(plate_no AS STRING) END AS plate_id FROM det), c AS (SELECT DISTINCT tile_id FROM det WHERE CAST(substr(tile_id, 6) AS INTEGER) % 2 = 0) SELECT count(DISTINCT tile_id) AS n_tiles, count(*) AS n_rows, count(*) FILTER (WHERE (plate_id IS NULL OR plate_id = '') AND CAST(substr(tile_id, 6) AS INTEGER) % 5 = 0) AS n_empty_plate FROM o WHERE tile_id NOT IN (SELECT tile_id FROM c)")
def promotion_totals(spark, d):
    rows = detections(spark, d).select("tile_id", "src_id", F.when(F.col("number") % 3 == 0, "").when(F.col("number") % 3 == 1, F.concat(F.lit("XE"), F.col("plate_no").cast("string"))).alias("plate_id"))
    n = F.substring("tile_id", 6, 9).cast("int")
    lookup = rows.select("tile_id").distinct().where(n % 5 != 0).withColumn("plate_id", F.concat(F.lit("XE-"), F.col("tile_id")))
    return master.promotion_summary(master.promote(rows, rows.where(n % 2 == 0), lookup))


@query(cte("det") + f", c AS (SELECT tile_id, number, FLAGS, MAG_AUTO, ra, dec FROM det), g AS (SELECT *, row_number() OVER (PARTITION BY tile_id, round_even(ra / {0.5 / 3600!r}, 0), round_even(dec / {0.5 / 3600!r}, 0) ORDER BY FLAGS, isnan(MAG_AUTO), MAG_AUTO, number) AS n FROM c), b AS (SELECT tile_id, CAST(floor(((ra % 360.0E0) + 360.0E0) % 360.0E0 / 5.0E0) AS INTEGER) AS ra_bin, CAST(floor((dec + 90.0E0) / 5.0E0) AS INTEGER) AS dec_bin FROM g WHERE n = 1) SELECT tile_id, ra_bin, dec_bin, count(*) AS n FROM b GROUP BY 1, 2, 3")
def master_bins(spark, d):
    rows = detections(spark, d).select("tile_id", F.col("number").alias("NUMBER"), "FLAGS", "MAG_AUTO", F.col("ra").alias("RA_corr"), F.col("dec").alias("Dec_corr"))
    return master.merge_tiles(rows).groupBy("tile_id", "ra_bin", "dec_bin").agg(F.count("*").alias("n"))


_BAND = repr(0.25 / 3600 + 1e-9)


def _manifest(eligible: str, core: str) -> str:
    return cte("det") + f""", s AS (SELECT concat(tile_id, ':', CAST(number AS STRING)) AS src_id, * EXCLUDE (src_id) FROM det),
u AS (SELECT src_id, tile_id, plate_no, ra, dec, {core} AS core FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY ra, dec) AS n FROM s) WHERE n = 1 AND {eligible}),
e AS (SELECT a.src_id AS a, b.src_id AS b FROM u a JOIN u b ON b.dec >= a.dec - {_BAND} AND b.dec <= a.dec + {_BAND} AND a.plate_no = b.plate_no AND a.src_id <> b.src_id WHERE {sep('a', 'b')} <= 0.25),
r AS (WITH RECURSIVE t(n, m) AS (SELECT src_id, src_id FROM u UNION SELECT e.b, t.m FROM t JOIN e ON e.a = t.n) SELECT n, min(m) AS m FROM t GROUP BY 1),
p AS (SELECT m, arg_min(n, (CASE WHEN core THEN 0 ELSE 1 END, n)) AS rep FROM r JOIN u ON u.src_id = r.n GROUP BY 1),
w AS (SELECT tile_id, count(*) AS n_emitted FROM s GROUP BY 1)
SELECT w.tile_id, w.n_emitted, count(*) AS n_rows, count(p.rep) AS n_kept, count(*) FILTER (WHERE core) AS n_core FROM w JOIN u USING (tile_id) LEFT JOIN p ON p.rep = u.src_id GROUP BY 1, 2"""


@query(_manifest("TRUE", "TRUE"))
def candidate_manifest(spark, d):
    rows = detections(spark, d).select("tile_id", F.col("number").alias("object_id"), "ra", "dec", F.col("plate_no").alias("plate_id"))
    return stages.build_candidates(rows)["manifest"]


_TILE_NO = "CAST(substr(tile_id, 6) AS INTEGER)"


@query(_manifest(f"{_TILE_NO} % 5 <> 0", f"{_TILE_NO} % 3 <> 1"))
def candidate_manifest_core(spark, d):
    """With a list of eligible tiles and an edge report: core by pixels, by arcseconds, or not at all."""
    rows = detections(spark, d).select("tile_id", F.col("number").alias("object_id"), "ra", "dec", F.col("plate_no").alias("plate_id"))
    tiles = cut(rows.select("tile_id").distinct())
    number = F.substring("tile_id", 6, 9).cast("int")
    edge = tiles.select("tile_id", F.when(number % 3 == 0, "core").otherwise("near_edge").alias("class_px"), F.when(number % 3 == 2, "CORE").otherwise("edge_touch").alias("class_arcsec"))
    return stages.build_candidates(rows, eligible=tiles.where(number % 5 != 0), edge=edge)["manifest"]


@query(cte("det") + ", f AS (SELECT *, CASE WHEN isfinite(FWHM_IMAGE) THEN (FWHM_IMAGE - 4) / 10.0E0 END AS r FROM det) SELECT count(r) AS n, min(r) AS min, max(r) AS max, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.9), 6) AS p90, CASE WHEN quantile_cont(r, 0.5) <= 0.3 AND quantile_cont(r, 0.9) <= 1.0 THEN 'OK' ELSE 'WARN' END AS status FROM f")
def residual_status(spark, d):
    rows = detections(spark, d).withColumn("r", (F.col("FWHM_IMAGE") - 4) / 10.0)
    return qc.residual_status(rows, "r").withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p90")})


_FLAGGED = cte("det") + """, vosa AS (SELECT DISTINCT concat('tile-', CAST(l_suppkey % 40 AS STRING)) AS tile_id, l_orderkey AS n FROM lineitem WHERE l_quantity > 44),
ptf AS (SELECT DISTINCT o_orderkey AS n FROM orders WHERE o_orderkey % 13 = 0), vsx AS (SELECT DISTINCT concat('tile-', CAST(l_suppkey % 40 AS STRING)) AS tile_id, l_orderkey AS n FROM lineitem WHERE l_tax > 0.07 AND l_suppkey % 3 = 0),
f AS (SELECT src_id, tile_id, (tile_id, number) IN (SELECT (tile_id, n) FROM vosa) AS vosa, number IN (SELECT n FROM ptf) AS ptf, (tile_id, number) IN (SELECT (tile_id, n) FROM vsx) AS vsx FROM det)"""


def _indexed(spark, d):
    lines, tile = read(spark, d, "lineitem"), F.concat(F.lit("tile-"), (F.col("l_suppkey") % 40).cast("string")).alias("tile_id")
    tables_ = {
        "vosa": lines.where("l_quantity > 44").select(tile, F.col("l_orderkey").alias("NUMBER")),
        "ptf": read(spark, d, "orders").where("o_orderkey % 13 = 0").select(F.col("o_orderkey").alias("NUMBER")),
        "vsx": lines.where("l_tax > 0.07 AND l_suppkey % 3 = 0").select(tile, F.col("l_orderkey").alias("NUMBER")),
    }
    return flags.indexed_survivors(detections(spark, d).select("src_id", "tile_id", F.col("number").alias("NUMBER")), flags.flag_index(tables_), [*tables_])


@query(_FLAGGED + " SELECT src_id, tile_id FROM f WHERE NOT vosa AND NOT ptf AND NOT vsx")
def flag_index_survivors(spark, d):
    """Gates as bitmaps by tile, one flag table without tiles."""
    return _indexed(spark, d)[0].select("src_id", "tile_id")


@query(_FLAGGED + " SELECT count(*) AS n_rows, count(*) FILTER (WHERE vosa) AS n_vosa, count(*) FILTER (WHERE ptf) AS n_ptf, count(*) FILTER (WHERE vsx) AS n_vsx, count(*) FILTER (WHERE NOT vosa AND NOT ptf AND NOT vsx) AS n_kept FROM f")
def flag_index_tallies(spark, d):
    return _indexed(spark, d)[1]
