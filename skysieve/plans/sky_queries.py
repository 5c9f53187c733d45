"""Queries of the sky joins, stages, spikes and spatial deduplication, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions import sky
from skysieve.operators import dedup, filters, plates, skyjoin, spikes
from skysieve.plans import stages
from skysieve.plans.derived import catalogue, cte, detections, pair_cte, read, sep

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _found(spark: SparkSession, d: str, role: str = "gaia", radius: float = 5.0) -> DataFrame:
    right = catalogue(spark, d, role).select("cat_id", "ra", "dec")
    return skyjoin.pairs(detections(spark, d).select("src_id", "ra", "dec"), right, radius)


@query(cte("det", "gaia") + f", p AS ({pair_cte('det', 'gaia', 5.0)}) SELECT src_id, cat_id, round(s, 4) AS sep FROM p")
def sky_pairs_all(spark, d):
    return _found(spark, d).select("src_id", "cat_id", F.round("sep_arcsec", 4).alias("sep"))


_BEST = "b AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY s, cat_id) AS n FROM p)"


@query(cte("det", "gaia") + f", p AS ({pair_cte('det', 'gaia', 5.0)}), {_BEST} SELECT DISTINCT src_id, cat_id, round(s, 4) AS sep FROM b WHERE n = 1")
def sky_match_best1(spark, d):
    return skyjoin.best_right(_found(spark, d), "src_id", "cat_id").select("src_id", "cat_id", F.round("sep_arcsec", 4).alias("sep"))


@query()
def sky_match_best_symmetric(spark, d):
    return skyjoin.symmetric(_found(spark, d, "ps1"), "src_id", "cat_id").select("src_id", "cat_id", F.round("sep_arcsec", 4).alias("sep"))


@query(cte("det", "gaia") + f", p AS ({pair_cte('det', 'gaia', 5.0)}) SELECT src_id, ra, dec FROM det WHERE src_id NOT IN (SELECT src_id FROM p)")
def sky_anti_any(spark, d):
    return skyjoin.anti(detections(spark, d).select("src_id", "ra", "dec"), catalogue(spark, d, "gaia"), 5.0, "src_id")


def _cascade(spark, d):
    rows = detections(spark, d).select("src_id", "ra", "dec")
    return stages.cascade(rows, [(r, catalogue(spark, d, r)) for r in ("gaia", "ps1", "usno")])


_STEPS = cte("det", "gaia", "ps1", "usno") + ", " + ", ".join(
    f"p{i} AS ({pair_cte(f'd{i}', r, 5.0)}), d{i + 1} AS (SELECT * FROM d{i} WHERE src_id NOT IN (SELECT src_id FROM p{i}))" if i else f"d0 AS (SELECT src_id, ra, dec FROM det), p0 AS ({pair_cte('d0', r, 5.0)}), d1 AS (SELECT * FROM d0 WHERE src_id NOT IN (SELECT src_id FROM p0))"
    for i, r in enumerate(("gaia", "ps1", "usno"))
)


@query(_STEPS + " SELECT src_id, ra, dec FROM d3")
def veto_cascade(spark, d):
    return _cascade(spark, d)[0]


@query(_STEPS + " " + " UNION ALL ".join(f"SELECT {i + 1} AS step, '{r}' AS veto, (SELECT count(*) FROM d{i}) AS n_before, (SELECT count(*) FROM d{i + 1}) AS n_after, (SELECT count(*) FROM d{i}) - (SELECT count(*) FROM d{i + 1}) AS n_eliminated, (SELECT count(*) FROM p{i}) AS n_pairs" for i, r in enumerate(("gaia", "ps1", "usno"))))
def veto_accounting(spark, d):
    return _cascade(spark, d)[1]


@query("WITH c AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 3600000) / 10000.0E0 AS ra, (((c_custkey * 104729) % 1600000) - 800000) / 10000.0E0 AS dec FROM customer), s AS (SELECT s_suppkey AS sid, ((s_suppkey * 15485863) % 3600000) / 10000.0E0 AS ra, (((s_suppkey * 32452843) % 1600000) - 800000) / 10000.0E0 AS dec FROM supplier), "
       f"p AS (SELECT a.id, b.sid, {sep('a', 'b')} AS s FROM c a CROSS JOIN s b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, sid) AS n FROM p) SELECT id, sid, round(s, 3) AS sep FROM r WHERE n = 1")
def sky_nearest_unbounded(spark, d):
    c = read(spark, d, "customer").selectExpr("c_custkey AS id", "((c_custkey * 7919) % 3600000) / 10000.0E0 AS ra", "(((c_custkey * 104729) % 1600000) - 800000) / 10000.0E0 AS dec")
    s = read(spark, d, "supplier").selectExpr("s_suppkey AS sid", "((s_suppkey * 15485863) % 3600000) / 10000.0E0 AS ra", "(((s_suppkey * 32452843) % 1600000) - 800000) / 10000.0E0 AS dec")
    found = skyjoin.nearest(c, s.withColumnsRenamed({"ra": "ra_s", "dec": "dec_s"}), "id", "sid", right_coords=("ra_s", "dec_s"))
    return found.select("id", "sid", F.round("sep_arcsec", 3).alias("sep"))


@query(cte("det", "usno") + f", p AS ({pair_cte('det', 'usno', 8.0)}), {_BEST} SELECT DISTINCT src_id, cat_id, round(s, 4) AS sep FROM b WHERE n = 1")
def sky_nearest_within(spark, d):
    found = _found(spark, d, "usno", 8.0)
    return skyjoin.best_right(found, "src_id", "cat_id").select("src_id", "cat_id", F.round("sep_arcsec", 4).alias("sep"))


@query(cte("det", "gaia") + f", p AS ({pair_cte('gaia', 'det', 5.0, 'a.cat_id')}), n AS (SELECT cat_id, count(*) AS c FROM p GROUP BY 1) SELECT g.cat_id, coalesce(n.c, 0) AS matched_count FROM gaia g LEFT JOIN n USING (cat_id)")
def sky_count_within(spark, d):
    return skyjoin.count_within(catalogue(spark, d, "gaia"), detections(spark, d), 5.0, "cat_id").select("cat_id", "matched_count")


@query(cte("det", "any") + f", g AS (SELECT * FROM any_ WHERE coalesce(ngoodobs, 0) > 0), p AS ({pair_cte('det', 'g', 5.0)}) SELECT src_id, ra, dec FROM det WHERE src_id IN (SELECT src_id FROM p)")
def sky_exists_gated(spark, d):
    good = catalogue(spark, d).where(F.coalesce("ngoodobs", F.lit(0)) > 0)
    return skyjoin.semi(detections(spark, d).select("src_id", "ra", "dec"), good, 5.0, "src_id")


@query(cte("det", "gaia") + f", p AS ({pair_cte('det', 'gaia', 5.0)}), {_BEST}, o AS (SELECT DISTINCT src_id, s FROM b WHERE n = 1), r AS (SELECT unnest([2.0E0, 5.0E0]) AS radius_arcsec) SELECT radius_arcsec, count(*) AS n_matched, round(count(*) * 1.0E0 / (SELECT count(*) FROM det), 6) AS rate FROM o JOIN r ON s <= radius_arcsec GROUP BY 1")
def multi_radius_rates(spark, d):
    best = skyjoin.best_right(_found(spark, d), "src_id", "cat_id")
    total = detections(spark, d).count()
    return skyjoin.multi_radius(best, (2.0, 5.0), total).withColumn("rate", F.round("rate", 6))


_NEARBY = cte("det", "gaia") + f", p AS ({pair_cte('det', 'gaia', 5.0)}), {_BEST}, m AS (SELECT DISTINCT src_id, s FROM b WHERE n = 1)"


@query(cte("det", "ps1") + f", north AS (SELECT * FROM det WHERE NOT dec < 0.0E0), p AS ({pair_cte('north', 'ps1', 5.0)}), m AS (SELECT src_id, min(s) AS s FROM p GROUP BY 1) SELECT src_id, det.dec < 0.0E0 AS removed_by_sh_cut, m.s IS NOT NULL AS has_ps1_match, round(m.s, 4) AS best_sep FROM det LEFT JOIN m USING (src_id)")
def southern_cut_ps1(spark, d):
    flags = stages.ps1_stage(detections(spark, d).select("src_id", "ra", "dec"), catalogue(spark, d, "ps1"), other="cat_id").flags
    return flags.select("src_id", "removed_by_sh_cut", "has_ps1_match", F.round("best_sep_arcsec", 4).alias("best_sep"))


@query(cte("det", "usno") + f", p AS ({pair_cte('det', 'usno', 5.0)}), m AS (SELECT src_id, min(s) AS s FROM p GROUP BY 1) SELECT src_id, m.s IS NOT NULL AS has_usnob_match, round(m.s, 4) AS best_sep FROM det LEFT JOIN m USING (src_id)")
def usno_flags(spark, d):
    flags = stages.usno_stage(detections(spark, d).select("src_id", "ra", "dec"), catalogue(spark, d, "usno"), other="cat_id").flags
    return flags.select("src_id", "has_usnob_match", F.round("best_sep_arcsec", 4).alias("best_sep"))


def _scos(mode):
    def run(spark, d):
        return stages.scos_stage(detections(spark, d).select("src_id", "ra", "dec"), catalogue(spark, d, "gaia"), mode=mode).kept

    return run


_HIT = cte("det", "gaia") + f", p AS ({pair_cte('det', 'gaia', 5.0)}) SELECT src_id, ra, dec FROM det WHERE src_id"
QUERIES |= {"scos_keep": _scos("keep_matches"), "scos_drop": _scos("drop_matches")}
SQL |= {"scos_keep": f"{_HIT} IN (SELECT src_id FROM p)", "scos_drop": f"{_HIT} NOT IN (SELECT src_id FROM p)"}


@query(cte("det", "any") + f", g AS (SELECT * FROM any_ WHERE coalesce(ngoodobs, 0) > 0), p AS ({pair_cte('det', 'g', 5.0)}) SELECT src_id, src_id IN (SELECT src_id FROM p) AS has_ptf_match_ngood FROM det")
def ptf_stage(spark, d):
    return stages.ptf_stage(detections(spark, d).select("src_id", "ra", "dec"), catalogue(spark, d)).flags.select("src_id", "has_ptf_match_ngood")


@query(cte("det", "usno") + f", p AS ({pair_cte('det', 'usno', 5.0)}), n AS (SELECT src_id, cat_id, s FROM p), m AS (SELECT src_id, count(*) AS c, min(s) AS s FROM n GROUP BY 1), u AS (SELECT src_id, count(*) AS k FROM det GROUP BY 1) SELECT det.src_id, CAST(coalesce(m.c, 0) AS BIGINT) AS matched_count, m.c IS NOT NULL AS is_known_variable_or_transient, round(m.s, 4) AS best_sep FROM det LEFT JOIN m USING (src_id)")
def vsx_stage(spark, d):
    flags = stages.vsx_stage(detections(spark, d).select("src_id", "ra", "dec"), catalogue(spark, d, "usno")).flags
    return flags.select("src_id", "matched_count", "is_known_variable_or_transient", F.round("best_sep_arcsec", 4).alias("best_sep"))


@query(cte("det", "ps1", "usno") + f", p AS ({pair_cte('det', 'ps1', 5.0)}), u AS ({pair_cte('det', 'usno', 5.0)}), f AS (SELECT src_id, src_id IN (SELECT src_id FROM p) AS has_ps1_match, src_id IN (SELECT src_id FROM u) AS has_usno_match FROM det) SELECT *, has_ps1_match OR has_usno_match AS any_match FROM f")
def vosa_any(spark, d):
    rows = detections(spark, d).select("src_id", "ra", "dec")
    return stages.flag_stage(rows, {r: catalogue(spark, d, r) for r in ("ps1", "usno")}).flags.select("src_id", "has_ps1_match", "has_usno_match", "any_match")


_FIELD = "concat(CAST(CAST(floor((dec + 90.0E0) / 1.0E0) AS BIGINT) AS STRING), '_', CAST(CAST(floor((((ra % 360.0E0) + 360.0E0) % 360.0E0) / (1.0E0 / greatest(1e-4, least(1.0E0, cos(radians(dec)))))) AS BIGINT) AS STRING), '__', CAST(plate_no AS STRING))"


@query(cte("det") + f", f AS (SELECT {_FIELD} AS field_id, ra, dec FROM det) SELECT field_id, round(median(ra), 6) AS ra_f, round(median(dec), 6) AS dec_f, count(*) AS n FROM f GROUP BY 1")
def skybot_fields(spark, d):
    rows = detections(spark, d).withColumn("plate_id", F.col("plate_no").cast("string")).withColumns({"epoch_iso": F.lit("1953-04-12"), "epoch_jd": F.lit(2434479.5)})
    return stages.fields(rows)[1].select("field_id", F.round("ra_f", 6).alias("ra_f"), F.round("dec_f", 6).alias("dec_f"), "n")


def _moving(spark, d):
    rows = detections(spark, d).withColumn("plate_id", F.col("plate_no").cast("string")).withColumns({"epoch_iso": F.lit("1953-04-12"), "epoch_jd": F.lit(2434479.5)})
    objects = rows.where("number % 3 = 0").select(sky.field_bucket("ra", "dec", "plate_id").alias("field_id"), (F.col("ra") + 0.001).alias("ra_o"), (F.col("dec") + 0.0005).alias("dec_o"))
    return stages.skybot_stage(rows, objects)


@query(cte("det") + f""", f AS (SELECT src_id, number, ra, dec, {_FIELD} AS field_id FROM det),
o AS (SELECT field_id, ra + 0.001E0 AS ra_o, dec + 0.0005E0 AS dec_o FROM f WHERE number % 3 = 0), m AS (SELECT field_id, median(dec_o) AS dm FROM o GROUP BY 1),
q AS (SELECT src_id, ((((f.ra * 0 + ra_o - f.ra + 180.0E0) % 360.0E0) + 360.0E0) % 360.0E0) - 180.0E0 AS dra, dec_o - f.dec AS dd, cos(radians((f.dec + dm) / 2.0E0)) AS c FROM f JOIN o USING (field_id) JOIN m USING (field_id)),
s AS (SELECT src_id, sqrt(pow(radians(dra * c), 2) + pow(radians(dd), 2)) * (180.0E0 / pi() * 3600.0E0) AS s FROM q),
b AS (SELECT src_id, min(s) AS s, count(*) FILTER (WHERE s <= 60.0E0) AS c FROM s GROUP BY 1)
SELECT f.src_id, coalesce(b.s <= 5.0E0, FALSE) AS has_skybot_match, coalesce(b.s > 5.0E0 AND b.s <= 60.0E0, FALSE) AS wide_skybot_match, CAST(coalesce(b.c, 0) AS BIGINT) AS matched_count, round(b.s, 3) AS best_sep FROM f LEFT JOIN b USING (src_id)""")
def skybot_flags(spark, d):
    return _moving(spark, d).flags.select("src_id", "has_skybot_match", "wide_skybot_match", "matched_count", F.round("best_sep_arcsec", 3).alias("best_sep"))


_STARS = "any_ WHERE isfinite(rmag) AND rmag > -900 AND rmag >= 0 AND rmag <= 16.0E0 AND nDetections >= 2"


@query(cte("any") + f" SELECT cat_id, rmag FROM {_STARS}")
def bright_star_filter(spark, d):
    return filters.bright_stars(catalogue(spark, d)).select("cat_id", "rmag")


def _spikes(spark, d):
    stars = filters.bright_stars(catalogue(spark, d)).withColumnRenamed("cat_id", "star_id")
    return spikes.judged(spikes.near_bright(detections(spark, d).select("src_id", "ra", "dec"), stars, "src_id"))


_SPIKE = cte("det", "any") + f", stars AS (SELECT * FROM {_STARS}), p AS ({pair_cte('det', 'stars', 90.0, 'a.src_id, b.cat_id, b.rmag')}), {_BEST}, m AS (SELECT DISTINCT src_id, s, rmag FROM b WHERE n = 1)"


@query(_SPIKE + " SELECT det.src_id, round(m.s, 3) AS sep, m.rmag AS bright_mag, coalesce(m.rmag <= 12.4E0 OR m.rmag < -0.09E0 * m.s + 15.3E0, FALSE) AS spike_reject FROM det LEFT JOIN m USING (src_id)")
def spike_rules(spark, d):
    return _spikes(spark, d).select("src_id", F.round("bright_sep_arcsec", 3).alias("sep"), "bright_mag", "spike_reject")


@query(_SPIKE + ", r AS (SELECT coalesce(CASE WHEN rmag <= 12.4E0 THEN 'CONST' END, '') AS a, coalesce(CASE WHEN rmag < -0.09E0 * s + 15.3E0 THEN 'LINE' END, '') AS b FROM det LEFT JOIN m USING (src_id)) SELECT CASE WHEN a <> '' AND b <> '' THEN a || ';' || b ELSE a || b END AS rules, count(*) AS n FROM r GROUP BY 1")
def spike_reasons(spark, d):
    return _spikes(spark, d).select(F.regexp_replace("spike_reason", r"\([^)]*\)", "").alias("rules")).groupBy("rules").agg(F.count("*").alias("n"))


@query(cte("any") + f" SELECT cat_id, CAST(floor(((ra % 360.0E0) + 360.0E0) % 360.0E0 / 5.0E0) AS INTEGER) AS ra_bin, CAST(floor((dec + 90.0E0) / 5.0E0) AS INTEGER) AS dec_bin FROM any_")
def sky_bins_index(spark, d):
    r, b = sky.sky_bins_index("ra", "dec")
    return catalogue(spark, d).select("cat_id", r.alias("ra_bin"), b.alias("dec_bin"))


@query(cte("any") + " SELECT cat_id, printf('%03d', CAST(floor(ra / 5.0E0) * 5 AS INTEGER)) AS ra_bin, printf('%+03d', CAST(floor(dec / 5.0E0) * 5 AS INTEGER)) AS dec_bin FROM any_")
def sky_bins_degree(spark, d):
    r, b = sky.sky_bins_degree("ra", "dec")
    return catalogue(spark, d).select("cat_id", r.alias("ra_bin"), b.alias("dec_bin"))


_GRID = 6.0 / 3600.0


@query(cte("det") + f", g AS (SELECT src_id, tile_id, ra, dec, row_number() OVER (PARTITION BY tile_id, round_even(ra / {_GRID!r}, 0), round_even(dec / {_GRID!r}, 0) ORDER BY FLAGS, isnan(MAG_AUTO), MAG_AUTO, src_id, ra) AS n FROM det) SELECT src_id, tile_id FROM g WHERE n = 1")
def dedup_grid_best(spark, d):
    rows = detections(spark, d).select("src_id", "tile_id", "ra", "dec", "FLAGS", "MAG_AUTO")
    return dedup.grid_best(rows, 6.0, [F.col("src_id"), F.col("ra")], group=["tile_id"]).select("src_id", "tile_id")


@query(cte("det") + f", g AS (SELECT src_id, tile_id, row_number() OVER (PARTITION BY round(ra / {_GRID!r}), round(dec / {_GRID!r}) ORDER BY tile_id, src_id, ra) AS n FROM det) SELECT src_id, tile_id FROM g WHERE n = 1")
def dedup_grid_first(spark, d):
    rows = detections(spark, d).select("src_id", "tile_id", "ra", "dec")
    return dedup.grid_first(rows, 6.0, [F.col("tile_id"), F.col("src_id"), F.col("ra")]).select("src_id", "tile_id")


@query(cte("det") + f""", u AS (SELECT DISTINCT src_id, ra, dec, plate_no FROM det), e AS (SELECT a.src_id AS a, b.src_id AS b FROM u a JOIN u b ON b.dec >= a.dec - {2.0 / 3600 + 1e-9!r} AND b.dec <= a.dec + {2.0 / 3600 + 1e-9!r} AND a.plate_no = b.plate_no AND a.src_id <> b.src_id WHERE {sep('a', 'b')} <= 2.0),
r AS (WITH RECURSIVE t(n, m) AS (SELECT src_id, src_id FROM u UNION SELECT e.b, t.m FROM t JOIN e ON e.a = t.n) SELECT n, min(m) AS m FROM t GROUP BY 1) SELECT n AS src_id, m AS cluster_id FROM r""")
def dedup_cluster(spark, d):
    rows = detections(spark, d).select("src_id", "ra", "dec", "plate_no").distinct()
    return dedup.clusters(rows, 2.0, "src_id", ["plate_no"]).select("src_id", "cluster_id")


@query("WITH t AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 36000) / 100.0E0 AS ra, (((s_suppkey * 104729) % 16000) - 8000) / 100.0E0 AS dec FROM supplier), c AS (SELECT p_partkey AS id, ((p_partkey * 15485863) % 36000) / 100.0E0 AS ra, (((p_partkey * 32452843) % 16000) - 8000) / 100.0E0 AS dec FROM part), "
       "p AS (SELECT a.id, b.id AS id_b, greatest(0.0E0, 0.5E0 - abs(((((a.ra - b.ra) + 180.0E0) % 360.0E0 + 360.0E0) % 360.0E0) - 180.0E0) * cos(radians((a.dec + b.dec) / 2.0E0))) * greatest(0.0E0, 0.5E0 - abs(a.dec - b.dec)) / 0.25E0 AS o FROM t a JOIN c b ON abs(a.dec - b.dec) < 0.5) SELECT id, id_b, round(o, 5) AS overlap FROM p WHERE o >= 0.05")
def tile_overlap(spark, d):
    t = read(spark, d, "supplier").selectExpr("s_suppkey AS id", "((s_suppkey * 7919) % 36000) / 100.0E0 AS ra", "(((s_suppkey * 104729) % 16000) - 8000) / 100.0E0 AS dec")
    c = read(spark, d, "part").selectExpr("p_partkey AS id", "((p_partkey * 15485863) % 36000) / 100.0E0 AS ra", "(((p_partkey * 32452843) % 16000) - 8000) / 100.0E0 AS dec")
    return plates.overlapping_tiles(t, c, 0.5, 0.05).select("id", "id_b", F.round("overlap", 5).alias("overlap"))


_PLATES = "SELECT s_suppkey AS plate_id, ((s_suppkey * 7919 * 31) % 36000) / 100.0E0 AS ra0, (((s_suppkey * 104729) % 16000) - 8000) / 100.0E0 AS dec0 FROM supplier"


@query(cte("any") + f", pl AS ({_PLATES}), b AS (SELECT a.cat_id, p.plate_id, {sep('a', 'p').replace('p.ra', 'p.ra0').replace('p.dec', 'p.dec0')} / 3600.0E0 AS s FROM any_ a JOIN pl p ON abs(a.dec - p.dec0) <= 3.51), r AS (SELECT *, row_number() OVER (PARTITION BY cat_id ORDER BY s, plate_id) AS n FROM b WHERE s <= 3.5) SELECT any_.cat_id, r.plate_id, round(r.s, 5) AS plate_sep_deg FROM any_ LEFT JOIN r ON any_.cat_id = r.cat_id AND r.n = 1")
def nearest_plate(spark, d):
    pl = read(spark, d, "supplier").selectExpr("s_suppkey AS plate_id", "((s_suppkey * 7919 * 31) % 36000) / 100.0E0 AS ra0", "(((s_suppkey * 104729) % 16000) - 8000) / 100.0E0 AS dec0")
    return plates.nearest_plate(catalogue(spark, d).select("cat_id", "ra", "dec"), pl, "cat_id").select("cat_id", "plate_id", F.round("plate_sep_deg", 5).alias("plate_sep_deg"))


_TILES = "SELECT CAST(s_suppkey AS STRING) AS tile_id, ((s_suppkey * 7919 * 31) % 36000) / 100.0E0 AS ra0, (((s_suppkey * 104729) % 16000) - 8000) / 100.0E0 AS dec0, 0.9E0 AS half_w, 0.8E0 AS half_h FROM supplier"
_DRA = "abs(((((a.ra - t.ra0) + 180.0E0) % 360.0E0 + 360.0E0) % 360.0E0) - 180.0E0)"


@query(cte("any") + f", t AS ({_TILES}), m AS (SELECT a.cat_id, t.tile_id, abs(a.dec - t.dec0) + {_DRA} AS s FROM any_ a JOIN t ON abs(a.dec - t.dec0) <= t.half_h AND {_DRA} * greatest(1e-6, cos(radians(t.dec0))) <= t.half_w), r AS (SELECT *, row_number() OVER (PARTITION BY cat_id ORDER BY s, tile_id) AS n FROM m) SELECT cat_id, tile_id FROM r WHERE n = 1")
def footprint_epoch(spark, d):
    t = read(spark, d, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS tile_id", "((s_suppkey * 7919 * 31) % 36000) / 100.0E0 AS ra0", "(((s_suppkey * 104729) % 16000) - 8000) / 100.0E0 AS dec0", "0.9E0 AS half_w", "0.8E0 AS half_h")
    return plates.covering_tile(catalogue(spark, d).select("cat_id", "ra", "dec"), t, "cat_id").select("cat_id", "tile_id")


_EDGES = """WITH pl AS (SELECT s_suppkey AS plate_id, ((s_suppkey * 7919) % 36000) / 100.0E0 AS ra0, (((s_suppkey * 104729) % 12000) - 6000) / 100.0E0 AS dec0 FROM supplier),
t AS (SELECT plate_id, ra0, dec0, k, ra0 + k / 2.0E0 AS ra, radians(dec0) AS d0 FROM pl CROSS JOIN (SELECT unnest(range(-7, 8)) AS k)),
s AS (SELECT *, radians(i * 0.25E0) AS x, radians(j * 0.25E0) AS y FROM t CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j)),
c AS (SELECT *, sqrt(x * x + y * y) AS rho, atan(sqrt(x * x + y * y)) AS c FROM s),
w AS (SELECT *, CASE WHEN rho > 0 THEN asin(cos(c) * sin(d0) + y * sin(c) * cos(d0) / rho) ELSE d0 END AS d,
  radians((((ra + CASE WHEN rho > 0 THEN degrees(atan2(x * sin(c), rho * cos(d0) * cos(c) - y * sin(d0) * sin(c))) ELSE 0 END - ra0 + 180.0E0) % 360.0E0) + 360.0E0) % 360.0E0 - 180.0E0) AS a FROM c),
g AS (SELECT *, sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a) AS depth FROM w),
q AS (SELECT *, 7000.0E0 - cos(d) * sin(a) / depth * (180.0E0 / pi() * 3600.0E0) / 1.7E0 AS px, 7000.0E0 + (cos(d0) * sin(d) - sin(d0) * cos(d) * cos(a)) / depth * (180.0E0 / pi() * 3600.0E0) / 1.7E0 AS py FROM g),
e AS (SELECT plate_id, k, min(CASE WHEN px < 1 OR px > 14000 OR py < 1 OR py > 14000 THEN -least(abs(px - 1), abs(14000 - px), abs(py - 1), abs(14000 - py)) ELSE least(px - 1, 14000 - px, py - 1, 14000 - py) END) AS m FROM q GROUP BY 1, 2)
SELECT CAST(plate_id AS STRING) || '/' || CAST(k AS STRING) AS tile_id, plate_id, round(m, 3) AS px, round(m * 1.7E0, 3) AS arcsec,
 CASE WHEN m < 0 THEN 'edge_touch' WHEN m >= 280 THEN 'core' ELSE 'near_edge' END AS class_px, CASE WHEN m < 0 THEN 'edge_touch' WHEN m * 1.7E0 >= 60 THEN 'core' ELSE 'near_edge' END AS class_arcsec FROM e"""


@query(_EDGES)
def plate_edge_class(spark, d):
    pl = read(spark, d, "supplier").selectExpr("s_suppkey AS plate_id", "((s_suppkey * 7919) % 36000) / 100.0E0 AS ra0", "(((s_suppkey * 104729) % 12000) - 6000) / 100.0E0 AS dec0", "14000 AS nx", "14000 AS ny", "1.7E0 AS arcsec_x", "1.7E0 AS arcsec_y")
    tiles = pl.select(F.explode(F.sequence(F.lit(-7), F.lit(7))).alias("k"), "plate_id", "ra0", "dec0").select(F.concat_ws("/", "plate_id", "k").alias("tile_id"), "plate_id", (F.col("ra0") + F.col("k") / 2.0).alias("ra"), F.col("dec0").alias("dec"))
    return plates.edge_report(tiles, pl).select("tile_id", "plate_id", F.round("min_edge_dist_px", 3).alias("px"), F.round("min_edge_dist_arcsec", 3).alias("arcsec"), "class_px", "class_arcsec")


@query(cte("det", "any") + f", m AS (SELECT det.src_id, det.ra, det.dec, c.ra AS gra, c.dec AS gdec, c.pmra, c.pmdec FROM det JOIN any_ c ON c.cat_id = det.number), "
       "t AS (SELECT *, radians(pmra * -66.0E0 / 1000.0E0 / 3600.0E0) AS x, radians(pmdec * -66.0E0 / 1000.0E0 / 3600.0E0) AS y, radians(gdec) AS d0 FROM m), "
       "r AS (SELECT *, sqrt(x * x + y * y) AS rho FROM t), "
       "b AS (SELECT src_id, ra, dec, CASE WHEN rho > 0 THEN gra + degrees(atan2(x * sin(atan(rho)), rho * cos(d0) * cos(atan(rho)) - y * sin(d0) * sin(atan(rho)))) ELSE gra END AS bra, CASE WHEN rho > 0 THEN degrees(asin(cos(atan(rho)) * sin(d0) + y * sin(atan(rho)) * cos(d0) / rho)) ELSE gdec END AS bdec FROM r), "
       f"s AS (SELECT a.src_id, {sep('a', 'a2').replace('a2.ra', 'a.bra').replace('a2.dec', 'a.bdec')} AS s FROM b a) SELECT src_id, round(s, 3) AS hpm_sep, s > 5.0E0 AS hpm FROM s")
def hpm_flag(spark, d):
    rows = detections(spark, d).select("src_id", "ra", "dec", "number").join(catalogue(spark, d).select(F.col("cat_id").alias("number"), F.col("ra").alias("gra"), F.col("dec").alias("gdec"), "pmra", "pmdec"), "number")
    ra, dec = sky.backpropagate("gra", "gdec", "pmra", "pmdec")
    s = sky.sep_arcsec("ra", "dec", ra, dec)
    return rows.select("src_id", F.round(s, 3).alias("hpm_sep"), (s > 5.0).alias("hpm"))
