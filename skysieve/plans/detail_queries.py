"""Queries of single functions, sources, sinks and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.functions import sky, text
from skysieve.operators import dedup, filters, flags, lookups, pixels, plates, skyjoin, spikes
from skysieve.plans import composites, master, qc, stages
from skysieve.plans.derived import GOOD_SHOT, catalogue, cte, detections, frames, pair_cte, read, sep, shots
from skysieve.session import cut, scratch
from skysieve.sources import tables, votable
from skysieve.streaming import retry

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_SUPPLIERS = "SELECT s_suppkey AS id, ((s_suppkey * 7919) % 36000) / 100.0E0 AS ra, (((s_suppkey * 104729) % 16000) - 8000) / 100.0E0 AS dec FROM supplier"
_MOVED = f"WITH p AS (SELECT *, ra + 0.01E0 AS ra2, dec + 0.005E0 AS dec2 FROM ({_SUPPLIERS}))"


def _suppliers(spark, d):
    return read(spark, d, "supplier").selectExpr("s_suppkey AS id", "((s_suppkey * 7919) % 36000) / 100.0E0 AS ra", "(((s_suppkey * 104729) % 16000) - 8000) / 100.0E0 AS dec")


def _moved(spark, d):
    return _suppliers(spark, d).selectExpr("*", "ra + 0.01E0 AS ra2", "dec + 0.005E0 AS dec2")


_H = "least(1.0E0, greatest(0.0E0, sin(radians(dec2 - dec) / 2) ** 2 + cos(radians(dec)) * cos(radians(dec2)) * sin(radians(ra2 - ra) / 2) ** 2))"


@query(_MOVED + f" SELECT id, round(2 * asin(sqrt({_H})) * 206264.806E0, 4) AS rounded_constant, round(degrees(acos(greatest(-1.0E0, least(1.0E0, sin(radians(dec)) * sin(radians(dec2)) + cos(radians(dec)) * cos(radians(dec2)) * cos(radians(ra - ra2))))))  * 3600, 1) AS cosines, round(degrees(2 * atan2(sqrt({_H}), sqrt(1 - {_H}))), 7) AS degrees, round(sqrt(((ra2 - ra) * cos(radians(dec))) ** 2 + (dec2 - dec) ** 2) * 3600, 4) AS residual FROM p")
def separations(spark, d):
    args = ("ra", "dec", "ra2", "dec2")
    return _moved(spark, d).select("id", F.round(sky.sep_rounded_constant(*args), 4).alias("rounded_constant"), F.round(sky.sep_cosines(*args), 1).alias("cosines"), F.round(sky.sep_degrees(*args), 7).alias("degrees"), F.round(sky.residual_arcsec(*args), 4).alias("residual"))


@query(f"WITH p AS ({_SUPPLIERS}) SELECT id, round(cos(radians(dec)) * cos(radians(ra)), 9) AS x, round(cos(radians(dec)) * sin(radians(ra)), 9) AS y, round(sin(radians(dec)), 9) AS z, CAST(trunc(cos(radians(dec)) * cos(radians(ra)) / 0.01E0) AS BIGINT) AS cell FROM p")
def unit_vectors(spark, d):
    x, y, z = sky.unit_xyz("ra", "dec")
    return _suppliers(spark, d).select("id", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(z, 9).alias("z"), (x / 0.01).cast("long").alias("cell"))


@query(f"""WITH p AS ({_SUPPLIERS}), v AS (SELECT id, cos(radians(dec)) * cos(radians(ra)) AS x, cos(radians(dec)) * sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM p),
t AS (SELECT *, -1.62557E-6 * x - 0.31919E-6 * y - 0.13843E-6 * z AS dot FROM v), q AS (SELECT id, x + 1.62557E-6 + dot * x AS x, y + 0.31919E-6 + dot * y AS y, z + 0.13843E-6 + dot * z AS z FROM t),
r AS (SELECT id, 0.9999256782 * x - 0.0111820611 * y - 0.0048579477 * z AS x, 0.0111820610 * x + 0.9999374784 * y - 0.0000271765 * z AS y, 0.0048579479 * x - 0.0000271474 * y + 0.9999881997 * z AS z FROM q)
SELECT id, round((degrees(atan2(y, x)) + 360) % 360, 8) AS ra, round(degrees(atan2(z, sqrt(x * x + y * y))), 8) AS dec FROM r""")
def b1950_positions(spark, d):
    ra, dec = sky.b1950_to_icrs("ra", "dec")
    return _suppliers(spark, d).select("id", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"))


@query("SELECT s_suppkey AS id, round((s_suppkey % 24 + (s_suppkey % 60) / 60.0E0 + ((s_suppkey * 7) % 600) / 36000.0E0) * 15, 9) AS ra, round(CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * (s_suppkey % 80 + ((s_suppkey * 3) % 60) / 60.0E0 + ((s_suppkey * 11) % 60) / 3600.0E0), 9) AS dec, split_part(concat(CAST(s_suppkey AS STRING), ':', s_name), ':', 1) AS tile FROM supplier")
def sexagesimal_positions(spark, d):
    rows = read(spark, d, "supplier").selectExpr("s_suppkey AS id", "concat_ws(' ', s_suppkey % 24, s_suppkey % 60, ((s_suppkey * 7) % 600) / 10.0D) AS ra_s", "concat(if(s_suppkey % 2 = 0, '-', '+'), concat_ws(':', s_suppkey % 80, (s_suppkey * 3) % 60, (s_suppkey * 11) % 60)) AS dec_s", "concat(s_suppkey, ':', s_name) AS row_id")
    return rows.select("id", F.round(text.sexagesimal("ra_s", True), 9).alias("ra"), F.round(text.sexagesimal("dec_s", False), 9).alias("dec"), text.tile_of("row_id").alias("tile"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '1951-03-04T05:06:07+00:00' WHEN s_suppkey % 3 = 1 THEN '1952-01-02T00:00:00+00:00' WHEN s_suppkey % 6 = 2 THEN '1953-01-01T12:00:00+00:00' END AS epoch, CASE WHEN s_suppkey % 3 = 0 THEN 'tile_header' WHEN s_suppkey % 3 = 1 THEN 'selected' WHEN s_suppkey % 6 = 2 THEN 'plate_header' END AS source FROM supplier")
def epoch_precedence(spark, d):
    rows = read(spark, d, "supplier").selectExpr("s_suppkey AS id", "if(s_suppkey % 3 = 0, '1951-03-04T05:06:07Z', 'unknown') AS a", "if(s_suppkey % 3 = 1, '1952-01-02', '') AS b", "if(s_suppkey % 6 IN (0, 1, 2), '1953-01-01 12:00', CAST(NULL AS STRING)) AS c")
    iso, tag = plates.chosen_epoch(F.col("a"), F.col("b"), F.col("c"))
    return rows.select("id", iso.alias("epoch"), tag.alias("source"))


_CD = "-0.0004 AS cd11, 0.00001E0 AS cd12, 0.00001E0 AS cd21, 0.0004E0 AS cd22"


@query(f"""WITH p AS ({_SUPPLIERS}), w AS (SELECT id, ra, dec, radians(-0.0004E0 * (id % 900 - 450) + 0.00001E0 * (id % 700 - 350)) AS x, radians(0.00001E0 * (id % 900 - 450) + 0.0004E0 * (id % 700 - 350)) AS y, radians(dec) AS d0 FROM p),
c AS (SELECT *, sqrt(x * x + y * y) AS rho, atan(sqrt(x * x + y * y)) AS c FROM w)
SELECT id, round((ra + CASE WHEN rho > 0 THEN degrees(atan2(x * sin(c), rho * cos(d0) * cos(c) - y * sin(d0) * sin(c))) ELSE 0 END + 360) % 360, 8) AS ra, round(degrees(CASE WHEN rho > 0 THEN asin(cos(c) * sin(d0) + y * sin(c) * cos(d0) / rho) ELSE d0 END), 8) AS dec,
round(sqrt(0.0004E0 ** 2 + 0.00001E0 ** 2) * 900 / 2, 9) AS half_w, round(sqrt(0.0004E0 ** 2 + 0.00001E0 ** 2) * 700 / 2, 9) AS half_h, round(sqrt(0.0004E0 ** 2 + 0.00001E0 ** 2) * 3600, 6) AS scale FROM c""")
def tile_corners(spark, d):
    cd = [F.lit(x) for x in (-0.0004, 0.00001, 0.00001, 0.0004)]
    ra, dec = sky.tan_pixel_to_world(F.col("id") % 900, F.col("id") % 700, F.lit(450), F.lit(350), "ra", "dec", *cd)
    w, h, scale = sky.footprint_half_sizes(F.lit(900), F.lit(700), *cd)
    return _suppliers(spark, d).select("id", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"), F.round(w, 9).alias("half_w"), F.round(h, 9).alias("half_h"), F.round(scale, 6).alias("scale"))


@query(f'WITH r AS (SELECT CAST(range AS BIGINT) AS row FROM range(-4, 5)), c AS (SELECT CAST(range AS INTEGER) AS "column" FROM range(-4, 5)), g AS (SELECT id, ra AS ra0, row, "column", radians(("column" + ((row % 2 + 2) % 2) * 0.5E0) * 0.5E0) AS x, radians(row * 0.5E0 * (sqrt(3.0E0) / 2)) AS y, radians(dec) AS d0 FROM ({_SUPPLIERS}), r, c), p AS (SELECT *, sqrt(x * x + y * y) AS rho, atan(sqrt(x * x + y * y)) AS c FROM g) SELECT id, row, "column", round((ra0 + CASE WHEN rho > 0 THEN degrees(atan2(x * sin(c), rho * cos(d0) * cos(c) - y * sin(d0) * sin(c))) ELSE 0 END + 360) % 360, 7) % 360 AS ra, round(degrees(CASE WHEN rho > 0 THEN asin(cos(c) * sin(d0) + y * sin(c) * cos(d0) / rho) ELSE d0 END), 7) AS dec FROM p')
def hexagonal_centres(spark, d):
    """A tessellation of every plate of a table."""
    found = plates.tessellated(_suppliers(spark, d), 2.0, 0.5, True)
    return found.select("id", "row", "column", (F.round("ra", 7) % 360).alias("ra"), F.round("dec", 7).alias("dec"))


@query(f"WITH p AS (SELECT id, ra, dec, CASE id % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'U' ELSE 'S' END AS letter FROM ({_SUPPLIERS})), g AS (SELECT CAST(a AS DOUBLE) AS ra, CAST(b AS DOUBLE) AS dec FROM (SELECT unnest(range(0, 360, 10)) AS a), (SELECT unnest(range(-90, 91, 10)) AS b)), n AS (SELECT g.ra, g.dec, letter, row_number() OVER (PARTITION BY g.ra, g.dec ORDER BY {sep('g', 'p')}, id) AS k FROM g JOIN p ON {sep('g', 'p')} <= 7 * 3600) SELECT g.ra, g.dec, coalesce(letter, '.') AS letter FROM g LEFT JOIN n ON n.ra = g.ra AND n.dec = g.dec AND k = 1")
def coverage_letters(spark, d):
    """The class letter of the plate nearest to each grid centre."""
    survey = F.when(F.col("id") % 3 == 0, "POSSI-E").when(F.col("id") % 3 == 1, "unknown").otherwise("SERC-J")
    return plates.coverage_grid(spark, _suppliers(spark, d).withColumn("survey", survey).withColumnsRenamed({"id": "plate_id", "ra": "ra0", "dec": "dec0"}), 10, 7.0)


@query("SELECT p_partkey AS id, CASE WHEN upper(p_type) LIKE '%POSS%' THEN 'POSS' ELSE 'UNKNOWN' END AS plain, CASE p_partkey % 5 WHEN 0 THEN 'SERC_AAO' WHEN 1 THEN 'SERC_AAO' WHEN 2 THEN 'SUPPLEMENTAL' WHEN 3 THEN 'POSS' ELSE 'UNKNOWN' END AS class FROM part")
def survey_classes(spark, d):
    names = F.array(*[F.lit(x) for x in ("SERC-J", "aao-r", "POSSI suppl", "POSSI-E", "")])
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.survey_class("p_type").alias("plain"), text.survey_class(F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("class"))


@query(cte("det") + " SELECT src_id, ra, dec FROM det WHERE (ra >= 350 OR ra <= 20) AND dec BETWEEN -20 AND 30")
def box_across_zero(spark, d):
    return detections(spark, d).where(sky.in_box("ra", "dec", 350.0, 20.0, -20.0, 30.0)).select("src_id", "ra", "dec")


@query(cte("det") + " SELECT tile_id, count(*) AS n FROM det WHERE FLAGS = 0 AND ELONGATION <= 1.7 AND MAG_AUTO > -13 GROUP BY 1")
def fit_quality_rows(spark, d):
    return filters.fit_quality(detections(spark, d)).groupBy("tile_id").agg(F.count("*").alias("n"))


@query(cte("det") + " SELECT src_id FROM det WHERE XMAX_IMAGE >= 2 AND XMAX_IMAGE <= 5 AND YMAX_IMAGE <= 4")
def pixel_bounds(spark, d):
    return filters.xy_bounds(detections(spark, d).withColumnsRenamed({"XMAX_IMAGE": "X_IMAGE", "YMAX_IMAGE": "Y_IMAGE"}), (2.0, 5.0), (None, 4.0)).select("src_id")


@query(f"WITH p AS ({_SUPPLIERS}) SELECT id, dec >= -30 AS tile, dec + 0.5E0 >= -30 AS cone FROM p")
def ps1_guard(spark, d):
    return _suppliers(spark, d).select("id", sky.col(filters.ps1_covered("dec")).alias("tile"), filters.ps1_covered("dec", 0.5).alias("cone"))


@query("SELECT event_id, value FROM events WHERE event_id % 700 <= 500 AND event_id % 10 = 0")
def unit_of_a_table(spark, d):
    rows = read(spark, d, "events").where("event_id % 10 = 0").selectExpr("event_id", "value", "(event_id % 700) / 100.0D AS s")
    return filters.within_arcsec_by_table(rows, "s").select("event_id", "value")


@query("SELECT event_id, event_id % 4 = 1 AS by_distance, event_id % 3 = 0 AS by_columns FROM events")
def hits_of_best_join(spark, d):
    rows = read(spark, d, "events").selectExpr("event_id", "CAST(event_id AS STRING) AS src_id", "CASE event_id % 4 WHEN 0 THEN 'nan' WHEN 1 THEN '1.5' WHEN 2 THEN '' END AS angDist", "if(event_id % 3 = 0, 'x', ' ') AS mag")
    return rows.select("event_id", lookups.is_hit(["src_id", "angDist", "mag"]).alias("by_distance"), lookups.is_hit(["src_id", "mag"]).alias("by_columns"))


@query("SELECT DISTINCT CAST(o_custkey AS STRING) AS NUMBER, TRUE AS has_match FROM orders WHERE o_custkey % 3 = 0")
def ids_after_a_match(spark, d):
    return lookups.matched_ids(read(spark, d, "orders").where("o_custkey % 3 = 0").selectExpr("CAST(o_custkey AS STRING) AS objID", "o_orderkey AS x"), "has_match")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE c_custkey END AS number FROM customer")
def object_numbers(spark, d):
    rows = read(spark, d, "customer").selectExpr("c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN concat(c_custkey, '.0') WHEN 1 THEN concat(' ', c_custkey) ELSE 'none' END AS object_id")
    return rows.select("id", text.object_number("object_id").alias("number"))


@query(cte("det") + f", c AS (SELECT src_id, {sep('det', 'o')} AS s FROM det, (SELECT 0.1E0 AS ra, 0.1E0 AS dec) o WHERE det.dec BETWEEN -20 AND 20) SELECT src_id, round(s, 3) AS sep FROM c WHERE s <= 36000")
def cone_of_one_position(spark, d):
    return lookups.cone(detections(spark, d).select("src_id", "ra", "dec"), 0.1, 0.1, 36_000.0).select("src_id", F.round("sep_arcsec", 3).alias("sep"))


@query(cte("det") + f", c AS (SELECT src_id, {sep('det', 'o')} AS s FROM det, (SELECT 100.0E0 AS ra, 10.0E0 AS dec) o) SELECT src_id, round(s, 3) AS sep FROM c WHERE s <= 72000 ORDER BY s, src_id LIMIT 1")
def nearest_in_a_cone(spark, d):
    return lookups.nearest_in_cone(detections(spark, d).select("src_id", "ra", "dec"), 100.0, 10.0, 72_000.0, "src_id").select("src_id", F.round("sep_arcsec", 3).alias("sep"))


@query(cte("det") + " SELECT tile_id, count(*) FILTER (WHERE number % 5 = 0) AS matched, count(*) FILTER (WHERE number % 5 <> 0) AS unmatched FROM det GROUP BY 1")
def match_reports(spark, d):
    rows = detections(spark, d).select("tile_id", F.col("number").alias("NUMBER"))
    hit = rows.where("NUMBER % 5 = 0").select(F.concat(F.col("NUMBER").cast("string"), F.lit(".0")).alias("NUMBER"))
    report = lookups.match_report(rows, hit)
    return report.groupBy("tile_id").agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched"))


@query(f"WITH p AS ({_SUPPLIERS}) SELECT a.id, b.id AS id_r FROM p a JOIN p b ON round(a.ra, 1) = round(b.ra, 1) AND round(a.dec, 1) = round(b.dec, 1)")
def rounded_positions(spark, d):
    p = _suppliers(spark, d)
    return lookups.join_rounded(p, p, 1).select("id", "id_r")


@query(cte("det", "ps1") + f", p AS ({pair_cte('det', 'ps1', 5.0)}) SELECT src_id, ra, dec FROM det WHERE src_id IN (SELECT src_id FROM p)")
def exists_ungated(spark, d):
    return skyjoin.semi(detections(spark, d).select("src_id", "ra", "dec"), catalogue(spark, d, "ps1"), 5.0, "src_id")


#: Rounds of the greedy pairing that the SQL unrolls; a further round must find nothing.
_ROUNDS = 8


def _greedy(pairs: str) -> str:
    steps, rest = [], pairs
    for k in range(_ROUNDS):
        steps.append(f"b{k} AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY s, src_id, cat_id) AS x, row_number() OVER (PARTITION BY cat_id ORDER BY s, src_id, cat_id) AS y FROM {rest})")
        steps.append(f"c{k} AS (SELECT src_id, cat_id, s FROM b{k} WHERE x = 1 AND y = 1)")
        steps.append(f"r{k} AS (SELECT src_id, cat_id, s FROM b{k} WHERE src_id NOT IN (SELECT src_id FROM c{k}) AND cat_id NOT IN (SELECT cat_id FROM c{k}))")
        rest = f"r{k}"
    return ", ".join(steps) + ", m AS (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(_ROUNDS)) + f" UNION ALL SELECT 'left over', count(*), 0 FROM r{_ROUNDS - 1} HAVING count(*) > 0)"


@query(cte("det", "ps1") + f", p AS ({pair_cte('det', 'ps1', 5.0)}), {_greedy('p')} SELECT src_id, cat_id, round(s, 4) AS sep FROM m")
def one_to_one_match(spark, d):
    right = catalogue(spark, d, "ps1").select("cat_id", F.col("ra").alias("ra_c"), F.col("dec").alias("dec_c"))
    found = skyjoin.match_symmetric(detections(spark, d).select("src_id", "ra", "dec"), right, 5.0, "src_id", "cat_id", right_coords=("ra_c", "dec_c"))
    return found.select("src_id", "cat_id", F.round("sep_arcsec", 4).alias("sep"))


@query(cte("det", "ps1") + f", p AS ({pair_cte('det', 'ps1', 5.0)}), {_greedy('p')} SELECT src_id, ra, dec FROM det WHERE src_id NOT IN (SELECT src_id FROM m)")
def unmatched_one_to_one(spark, d):
    return skyjoin.anti(detections(spark, d).select("src_id", "ra", "dec"), catalogue(spark, d, "ps1"), 5.0, "src_id", mode="best", right_key="cat_id")


#: The same pairing, registered with the sky joins.
SQL["sky_match_best_symmetric"] = SQL["one_to_one_match"]


@query(cte("det", "usno") + f", q AS (SELECT src_id AS cat_id, ra, dec FROM det WHERE number % 2 = 0), u AS (SELECT cat_id AS src_id, ra, dec FROM usno), p AS ({pair_cte('u', 'q', 2.0)}), {_greedy('(SELECT CAST(src_id AS STRING) AS src_id, cat_id, s FROM p)').replace(chr(39) + 'left over' + chr(39) + ', count(*), 0', chr(39) + 'left over' + chr(39) + ', CAST(count(*) AS STRING), 0')} SELECT (SELECT count(*) FROM m) AS n_matched, (SELECT count(*) FROM u) - (SELECT count(*) FROM m) AS n_unmatched, round((SELECT median(s) FROM m), 4) AS median_sep")
def science_catalogue_match(spark, d):
    science = catalogue(spark, d, "usno").select(F.col("cat_id").alias("row_id"), "ra", "dec")
    found, rest = composites.science_match(science, detections(spark, d).where("number % 2 = 0").select("src_id", "ra", "dec"))
    left = rest.agg(F.count("*").alias("n_unmatched"))
    return found.agg(F.count("*").alias("n_matched"), F.round(F.median("sep_arcsec"), 4).alias("median_sep")).crossJoin(left)


@query(cte("det") + ", e AS (SELECT DISTINCT plate_no FROM det) SELECT src_id, concat('P', CAST(plate_no AS STRING)) AS plate_id, 2433282.5E0 + plate_no AS epoch_jd FROM det")
def epochs_by_plate(spark, d):
    rows = detections(spark, d).select("src_id", F.concat_ws("/", "tile_id", "plate_no").alias("tile_id"), "plate_no")
    to_plate = rows.select("tile_id", F.concat(F.lit("P"), F.col("plate_no").cast("string")).alias("plate_id")).distinct()
    epochs = rows.select(F.concat(F.lit("P"), F.col("plate_no").cast("string")).alias("plate_id"), (F.lit(2433282.5) + F.col("plate_no")).alias("jd"), F.lit("1950").alias("date_obs_iso")).distinct()
    return plates.epoch_chain(rows.select("src_id", "tile_id"), to_plate, epochs).select("src_id", "plate_id", "epoch_jd")


@query("SELECT c_custkey AS src_id, CASE WHEN c_custkey % 7 = 0 THEN 10.0E0 WHEN c_nationkey % 2 = 0 THEN 20.0E0 + c_nationkey ELSE 30.0E0 END AS epoch_mjd FROM customer")
def epoch_sources(spark, d):
    rows = read(spark, d, "customer").selectExpr("c_custkey AS src_id", "c_nationkey AS plate_id")
    by_plate = read(spark, d, "nation").where("n_nationkey % 2 = 0").selectExpr("n_nationkey AS plate_id", "20.0D + n_nationkey AS epoch_mjd")
    return lookups.with_epoch(rows, rows.where("src_id % 7 = 0").selectExpr("src_id", "10.0D AS epoch_mjd"), by_plate, 30.0).select("src_id", "epoch_mjd")


@query(cte("det") + " SELECT DISTINCT CASE WHEN plate_no % 2 = 0 THEN concat(tile_id, '#', CAST(number AS STRING)) ELSE CAST(number AS STRING) END AS opt_source_id, ra, dec FROM det")
def position_seeds(spark, d):
    rows = detections(spark, d).select(F.when(F.col("plate_no") % 2 == 0, F.col("tile_id")).alias("tile_id"), F.col("number").alias("NUMBER"), F.col("ra").alias("ra_deg"), F.col("dec").alias("dec_deg"))
    return lookups.seed(rows).distinct()


@query("SELECT c_custkey AS row_id, c_custkey % 6 = 0 AS has_ir_match, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 50) / 10.0E0 END AS dist_arcsec FROM customer")
def whole_sidecar(spark, d):
    rows = read(spark, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey AS row_id", "explode(array(0, 1)) AS k", "c_custkey % 6 = 0 AS m", "(c_custkey % 50) / 10.0D AS s")
    rows = rows.selectExpr("row_id", "m AND k = 1 AS has_ir_match", "if(k = 0, s, if(row_id % 2 = 0, s + 1, double('NaN'))) AS dist_arcsec")
    seed = read(spark, d, "customer").selectExpr("c_custkey AS row_id")
    return flags.full_sidecar(seed, flags.collapse(rows, "row_id"), "row_id")


@query("SELECT c_custkey AS row_id, c_nationkey AS NUMBER, c_custkey % 4 = 0 AS by_row, c_nationkey % 3 = 0 AS by_number FROM customer")
def flags_by_mixed_keys(spark, d):
    base = read(spark, d, "customer").selectExpr("c_custkey AS row_id", "c_nationkey AS NUMBER")
    by_row = base.where("row_id % 4 = 0").selectExpr("row_id", "explode(array('yes', 'no')) AS by_row")
    by_number = base.where("NUMBER % 3 = 0").selectExpr("NUMBER", "1 AS by_number")
    return flags.masked_union(base, {"by_row": (by_row, "row_id"), "by_number": (by_number, "NUMBER")})


@query("""WITH t AS (SELECT c_custkey AS tile_id, ((c_custkey * 7919) % 3600000) / 10000.0E0 AS ra, (((c_custkey * 104729) % 1600000) - 800000) / 10000.0E0 AS dec, CASE WHEN c_custkey % 4 = 0 THEN concat('R', CAST(c_custkey % 30 AS STRING)) END AS region FROM customer),
p AS (SELECT s_suppkey AS plate_id, concat('R', CAST(s_suppkey % 20 AS STRING)) AS region, CASE WHEN s_suppkey % 2 = 0 THEN 'POSSI-E' ELSE 'SERC' END AS survey, ((s_suppkey * 7919) % 36000) / 100.0E0 AS ra, (((s_suppkey * 104729) % 16000) - 8000) / 100.0E0 AS dec FROM supplier),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY survey <> 'POSSI-E', plate_id) AS n FROM p) WHERE n = 1),
a AS (SELECT t.tile_id, t.ra, t.dec, f.plate_id AS by_region FROM t LEFT JOIN f USING (region)),
""" + f"n AS (SELECT * FROM (SELECT a.tile_id, b.plate_id, {sep('a', 'b')} / 3600 AS s, row_number() OVER (PARTITION BY a.tile_id ORDER BY {sep('a', 'b')}, b.plate_id) AS k FROM a JOIN p b ON b.dec BETWEEN a.dec - 4.001 AND a.dec + 4.001 WHERE a.by_region IS NULL) WHERE k = 1 AND s < 4.0) SELECT a.tile_id, coalesce(a.by_region, n.plate_id) AS plate_id, round(n.s, 6) AS sep_deg, CASE WHEN a.by_region IS NOT NULL THEN 'region' WHEN n.plate_id IS NULL THEN 'none' WHEN n.s >= 1.0 THEN 'nearest_far' ELSE 'nearest' END AS method FROM a LEFT JOIN n USING (tile_id)")
def plate_by_region(spark, d):
    tiles = read(spark, d, "customer").selectExpr("c_custkey AS tile_id", "((c_custkey * 7919) % 3600000) / 10000.0E0 AS ra", "(((c_custkey * 104729) % 1600000) - 800000) / 10000.0E0 AS dec", "if(c_custkey % 4 = 0, concat('R', c_custkey % 30), NULL) AS region")
    held = _suppliers(spark, d).selectExpr("id AS plate_id", "concat('R', id % 20) AS region", "if(id % 2 = 0, 'POSSI-E', 'SERC') AS survey", "ra AS ra0", "dec AS dec0")
    return plates.plate_of_tile(tiles, held).select("tile_id", "plate_id", F.round("plate_sep_deg", 6).alias("sep_deg"), "method")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def uncovered_ids(spark, d):
    return flags.unmatched(read(spark, d, "customer").selectExpr("c_custkey AS id"), read(spark, d, "orders").selectExpr("o_custkey AS id"), "id")


@query(cte("det") + f""", u AS (SELECT DISTINCT src_id, ra, dec FROM det WHERE plate_no < 5), e AS (SELECT a.src_id AS a, b.src_id AS b FROM u a JOIN u b ON b.dec >= a.dec - {2.0 / 3600 + 1e-9!r} AND b.dec <= a.dec + {2.0 / 3600 + 1e-9!r} AND a.src_id <> b.src_id WHERE {sep('a', 'b')} <= 2.0),
r AS (WITH RECURSIVE t(n, m) AS (SELECT src_id, src_id FROM u UNION SELECT e.b, t.m FROM t JOIN e ON e.a = t.n) SELECT n, min(m) AS m FROM t GROUP BY 1) SELECT m AS rep_id, bool_or(length(n) % 3 = 0) AS flag FROM r GROUP BY 1""")
def flags_on_representatives(spark, d):
    rows = detections(spark, d).where("plate_no < 5").select("src_id", "ra", "dec").distinct()
    flagged = rows.where("length(src_id) % 3 = 0").select("src_id", F.lit(True).alias("flag"))
    return dedup.flags_of_members(dedup.clusters(rows, 2.0, "src_id"), "src_id", flagged, ["flag"])


@query("WITH h AS (SELECT s_suppkey % 20 AS plate_id, make_timestamp(1950 + s_suppkey % 9, 1 + s_suppkey % 12, 3, 0, 0, 0) AS t FROM supplier) SELECT concat('XE', CAST(plate_id AS STRING)) AS plate_id, strftime(min(t), '%Y-%m-%dT%H:%M:%S+00:00') AS date_obs_iso, epoch(min(t)) / 86400.0E0 + 2440587.5E0 AS jd FROM h GROUP BY 1")
def first_epoch_of_plates(spark, d):
    headers = read(spark, d, "supplier").selectExpr("concat(' XE', s_suppkey % 20) AS REGION", "date_format(make_date(1950 + s_suppkey % 9, 1 + s_suppkey % 12, 3), 'yyyy-MM-dd') AS `DATE-OBS`")
    return plates.plate_epochs(headers)


@query(cte("det") + " SELECT tile_id, count(*) AS n, median(CASE WHEN NOT isnan(FWHM_IMAGE) THEN FWHM_IMAGE END) AS fwhm, median(ra) AS ra, median(dec) AS dec FROM det GROUP BY 1")
def dashboard_tiles(spark, d):
    return detections(spark, d).groupBy("tile_id").agg(F.count("*").alias("n"), F.median(F.when(sky.finite("FWHM_IMAGE"), F.col("FWHM_IMAGE"))).alias("fwhm"), F.median("ra").alias("ra"), F.median("dec").alias("dec"))


@query(cte("det") + " SELECT number, median(ra) AS ra, median(dec) AS dec, count(*) AS n FROM det GROUP BY 1")
def median_positions(spark, d):
    return detections(spark, d).groupBy("number").agg(F.median("ra").alias("ra"), F.median("dec").alias("dec"), F.count("*").alias("n"))


@query(cte("det") + ", g AS (SELECT tile_id, median(FWHM_IMAGE) FILTER (WHERE NOT isnan(FWHM_IMAGE)) AS fwhm FROM det GROUP BY 1) SELECT tile_id, fwhm FROM g ORDER BY fwhm DESC, tile_id LIMIT 5")
def blurriest_tiles(spark, d):
    tiles = detections(spark, d).groupBy("tile_id").agg(F.median(F.when(sky.finite("FWHM_IMAGE"), F.col("FWHM_IMAGE"))).alias("fwhm"))
    return qc.top(tiles, "fwhm", 5)


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, nation LIMIT 10")
def largest_groups(spark, d):
    return read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "nation").limit(10)


@query(cte("det") + " SELECT count(*) AS n, count(*) FILTER (WHERE isnan(FWHM_IMAGE)) AS blank, count(*) FILTER (WHERE SNR_WIN > 30 AND NOT isnan(SNR_WIN)) AS strong, count(*) FILTER (WHERE FLAGS = 0 AND NOT (SNR_WIN > 30 AND NOT isnan(SNR_WIN))) AS weak FROM det")
def funnel_buckets(spark, d):
    strong = sky.finite("SNR_WIN") & (F.col("SNR_WIN") > 30)
    return composites.buckets(detections(spark, d), {"n": F.lit(True), "blank": F.isnan("FWHM_IMAGE"), "strong": strong, "weak": (F.col("FLAGS") == 0) & ~strong})


@query("SELECT DISTINCT o_custkey % 40 AS tile, o_orderstatus AS status FROM orders")
def distinct_rows(spark, d):
    return read(spark, d, "orders").selectExpr("o_custkey % 40 AS tile", "o_orderstatus AS status").dropDuplicates()


@query("SELECT DISTINCT l_orderkey AS NUMBER, TRUE AS flagged FROM lineitem WHERE l_quantity > 25")
def flag_by_number(spark, d):
    return lookups.matched_ids(read(spark, d, "lineitem").where("l_quantity > 25").selectExpr("l_orderkey AS NUMBER"), "flagged")


@query("SELECT event_id, contains(lower(m), 'malformed coordinates') OR contains(lower(m), 'saxparseexception') AS domain FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Malformed Coordinates' WHEN 1 THEN 'read timed out' WHEN 2 THEN 'org.xml.sax.SAXParseException: x' ELSE '' END AS m FROM events)")
def service_errors(spark, d):
    said = F.element_at(F.array(F.lit("Malformed Coordinates"), F.lit("read timed out"), F.lit("org.xml.sax.SAXParseException: x"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", qc.domain_error(said).alias("domain"))


@query("SELECT s_suppkey AS tile_id, s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 AS needed FROM supplier")
def needed_steps(spark, d):
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("tile_id"))
    names = F.array_compact(F.array(F.lit("log.txt"), F.when(F.col("tile_id") % 3 != 0, "sex_a_xmatch.csv"), F.when(F.col("tile_id") % 2 != 0, "sex_a_xmatch_within5arcsec.csv")))
    return qc.needs_step(rows.select("tile_id", F.explode(names).alias("name")), r"^sex_.*_xmatch(_cdss)?\.csv$", "_within5arcsec.csv")


@query("SELECT o_orderkey AS star_id, round(greatest(CASE WHEN m <= 12.4 THEN 90.0E0 ELSE 0 END, least(90.0E0, greatest(0.0E0, (m - 15.3E0) / -0.09E0))), 6) AS radius FROM (SELECT o_orderkey, 8.0E0 + (o_orderkey % 90) / 10.0E0 AS m FROM orders)")
def mask_circles(spark, d):
    rows = read(spark, d, "orders").selectExpr("o_orderkey AS star_id", "1 AS x", "8.0D + (o_orderkey % 90) / 10.0D AS Vmag")
    return rows.select("star_id", F.round(F.greatest(F.lit(0.0), spikes.mask_radius(F.col(spikes.magnitude_column(rows.columns)))), 6).alias("radius"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'has_catalogue without has_image' ELSE '' END AS warnings, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN 'has_catalogue' ELSE 'has_image' END AS last_step FROM customer")
def tile_states(spark, d):
    rows = read(spark, d, "customer").selectExpr("c_custkey AS id", "c_custkey % 2 <> 0 AS has_image", "c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS has_catalogue")
    return qc.tile_status(rows).select("id", F.array_join("warnings", ";").alias("warnings"), "last_step")


# sources and sinks: a derived table is written to a scratch folder and read back


@query(cte("det") + " SELECT tile_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(FLAGS) AS DOUBLE) AS flags FROM det GROUP BY 1")
def csv_tables(spark, d):
    path = scratch(spark, "csv")
    rows = detections(spark, d).select("src_id", F.col("tile_id").alias(" tile_id "), F.col("FLAGS").alias("﻿FLAGS"))
    rows.write.option("header", True).csv(path)
    back = tables.read_csv(spark, path)
    return back.groupBy("tile_id").agg(F.count("*").alias("n"), F.sum(text.number("FLAGS")).alias("flags"))


@query("SELECT o_orderkey AS id, o_custkey % 7 AS k FROM orders WHERE o_orderkey % 5 <> 0")
def csv_with_bad_lines(spark, d):
    path = scratch(spark, "bad")
    line = F.when(F.col("o_orderkey") % 5 == 0, F.concat_ws(",", "o_orderkey", "o_custkey", F.lit("x"), F.lit("y"))).otherwise(F.concat_ws(",", "o_orderkey", (F.col("o_custkey") % 7)))
    read(spark, d, "orders").select(line.alias("value")).coalesce(1).write.text(path)
    head = scratch(spark, "bad-head")
    spark.createDataFrame([("id,k",)], "value string").unionByName(spark.read.text(path)).coalesce(1).write.text(head)
    return tables.read_csv(spark, head, skip_bad=True).select(F.col("id").cast("long").alias("id"), F.col("k").cast("long").alias("k"))


@query("SELECT concat('tile-RA=', s_nationkey) AS tile_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(s_suppkey) AS BIGINT) AS ids, CAST(1 AS BIGINT) AS images FROM supplier GROUP BY 1")
def tiles_of_layouts(spark, d):
    flat, sharded = scratch(spark, "tiles"), scratch(spark, "tiles")
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("tile-RA"))
    for path in (flat, f"{sharded}/shard"):  # one file a tile, every tile in both layouts
        rows.repartition("tile-RA").write.option("header", True).partitionBy("tile-RA").csv(path)
    found = tables.read_tiles(spark, [f"{flat}/*/*.csv", f"{sharded}/*/*/*.csv"])
    return found.groupBy("tile_id").agg(F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"), F.countDistinct("image_id").alias("images"))


@query("SELECT region, sum(n) AS n, count(flag) AS flagged FROM (SELECT n_regionkey AS region, 1 AS n, NULL AS flag FROM nation UNION ALL SELECT r_regionkey, 1, 'x' FROM region) GROUP BY 1")
def union_of_headers(spark, d):
    a = read(spark, d, "nation").selectExpr("n_regionkey AS region", "1 AS n")
    b = read(spark, d, "region").selectExpr("'x' AS flag", "r_regionkey AS region", "1 AS n")
    both = tables.union_by_name([a, b])
    return both.groupBy("region").agg(F.sum("n").alias("n"), F.count("flag").alias("flagged"))


_BINS = ", b AS (SELECT src_id, tile_id, CAST(floor(((ra % 360.0E0) + 360.0E0) % 360.0E0 / 5.0E0) AS INTEGER) AS ra_bin, CAST(floor((dec + 90.0E0) / 5.0E0) AS INTEGER) AS dec_bin FROM det)"


def _binned(spark, d):
    ra_bin, dec_bin = sky.sky_bins_index("ra", "dec")
    return detections(spark, d).select("src_id", "tile_id", ra_bin.alias("ra_bin"), dec_bin.alias("dec_bin"))


@query(cte("det") + _BINS + " SELECT ra_bin, dec_bin, count(*) AS n FROM b WHERE ra_bin < 4 AND dec_bin BETWEEN 14 AND 17 GROUP BY 1, 2")
def partitioned_master(spark, d):
    path, rows = scratch(spark, "master"), _binned(spark, d).where("ra_bin < 6 AND dec_bin BETWEEN 12 AND 17")
    half = F.substring("tile_id", 6, 9).cast("int") % 2 == 0
    master.publish(rows.where(half), path)
    master.publish(rows, path)  # only the tiles that aren't there yet
    return spark.read.parquet(path).where("ra_bin < 4 AND dec_bin >= 14").groupBy("ra_bin", "dec_bin").agg(F.count("*").alias("n"))


@query(cte("det") + " SELECT tile_id, count(*) AS n FROM det WHERE plate_no < 2 GROUP BY 1")
def pruned_leaves(spark, d):
    path = scratch(spark, "leaves")
    detections(spark, d).where("plate_no < 2").select("src_id", "tile_id", "ra", "plate_no").write.partitionBy("plate_no").parquet(path)
    leaves = tables.read_leaves(spark, [f"{path}/plate_no={k}" for k in range(4)], ["tile_id", "ra"])
    return leaves.groupBy("tile_id").agg(F.count("*").alias("n"))


@query("SELECT lpad(CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS STRING), 5, '0') AS chunk, o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def numbered_chunks(spark, d):
    path = scratch(spark, "chunks")
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    tables.write_chunks(rows, path, "id", 1_000, width=5)
    back = spark.read.option("header", True).schema(rows.schema).option("recursiveFileLookup", "true").csv(path)
    return back.select("*", F.regexp_extract(F.col("_metadata.file_path"), "chunk=([0-9]+)", 1).alias("chunk"))


@query("SELECT 'full' AS part, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer UNION ALL SELECT concat('chunk-', CAST(k AS STRING)), count(*), CAST(sum(c_custkey) AS BIGINT) FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 400 + 1 AS k FROM customer) WHERE (SELECT count(*) FROM customer) > 400 GROUP BY k UNION ALL SELECT 'small', count(*), CAST(sum(n_nationkey) AS BIGINT) FROM nation")
def full_and_chunks(spark, d):
    path, small = scratch(spark, "full"), scratch(spark, "full")
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal")
    tables.write_full_and_chunks(rows, path, "id", 400)
    tables.write_full_and_chunks(read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name"), small, "id", 400)
    back = spark.read.option("header", True).schema("id long").option("recursiveFileLookup", "true").csv([path, small])
    file = F.col("_metadata.file_path")
    part = F.when(file.contains("/full/"), F.when(file.contains(small.rsplit("/", 1)[1]), "small").otherwise("full")).otherwise(F.concat(F.lit("chunk-"), F.regexp_extract(file, "chunk=([0-9]+)", 1).cast("long").cast("string")))
    return back.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT s_suppkey AS id, s_acctbal AS balance, CASE WHEN s_nationkey < 10 THEN s_nationkey END AS nation FROM supplier")
def fixed_width_lines(spark, d):
    path = scratch(spark, "lines")
    rows = read(spark, d, "supplier")
    nation = F.when(F.col("s_nationkey") < 10, F.col("s_nationkey").cast("string")).otherwise("-")
    rows.select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 8, " "), F.lpad(F.col("s_acctbal").cast("string"), 14, " "), F.lpad(nation, 3, " ")).alias("value")).write.text(path)
    return tables.read_fixed_width(spark, path, {"id": (1, 8, "bigint"), "balance": (9, 14, "double"), "nation": (23, 3, "int")})


_KINDS = "CASE WHEN n_nationkey % 6 = 1 THEN concat(n_name, chr(9), 'x') WHEN n_nationkey % 6 = 3 THEN concat(n_name, 'é') WHEN n_nationkey % 6 = 4 THEN concat(n_name, 'é') ELSE n_name END"


@query(f"SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 <> 5 THEN concat('R', n_regionkey) END AS region, CASE WHEN n_nationkey % 6 <> 5 THEN {_KINDS} END AS name, CASE WHEN n_nationkey % 6 <> 5 THEN n_nationkey * 1.5E0 END AS ra FROM nation")
def headers_of_kinds(spark, d):
    """One folder of header, selected and root objects, with raw tabs in strings, a byte-order mark, Latin-1, control characters between
    values, and files that don't parse."""
    path, k = scratch(spark, "headers"), F.col("n_nationkey") % 6
    raw = lambda code: F.unhex(F.lit(code)).cast("string")
    name = F.when(k == 1, F.concat("n_name", raw("09"), F.lit("x"))).when(k == 3, F.concat("n_name", F.lit("é"))).when(k == 4, F.concat("n_name", raw("E9"))).otherwise(F.col("n_name"))
    inner = F.concat(F.lit('{"REGION": "R'), F.col("n_regionkey").cast("string"), F.lit('", "NOTE": "'), name, F.lit('", "PLATERA": '), (F.col("n_nationkey") * F.lit(1.5)).cast("string"), F.when(k == 4, raw("01")).otherwise(F.lit("")), F.lit(', "more": {"REGION": 1}}'))
    text = F.when(k == 0, F.concat(F.lit('{"header": '), inner, F.lit(', "selected": {"REGION": "no"}}'))).when(k == 1, F.concat(F.lit('{"header": null, "selected": '), inner, F.lit("}"))).when(k == 3, F.concat(raw("EFBBBF"), inner)).when(k == 5, F.concat(F.lit('{"header": '), inner)).otherwise(inner)
    read(spark, d, "nation").select("n_nationkey", text.alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("n_nationkey").text(path)
    heads = tables.read_headers(spark, f"{path}/*/*.txt", ["REGION", "NOTE", "PLATERA"])
    return heads.select(F.regexp_extract("file", "n_nationkey=([0-9]+)", 1).cast("long").alias("id"), F.col("REGION").alias("region"), F.col("NOTE").alias("name"), F.col("PLATERA").cast("double").alias("ra"))


@query("SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS STRING) AS region FROM nation")
def sidecars_and_reports(spark, d):
    path = scratch(spark, "notes")
    lines = F.concat(F.lit("name: "), F.col("n_name"), F.lit("\nno key here\nregion : "), F.col("n_regionkey").cast("string"), F.lit("\nid: "), F.col("n_nationkey").cast("string"))
    read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), lines.alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("k").text(path)
    pairs = tables.read_sidecar(spark, f"{path}/*").groupBy("file").pivot("key", ["id", "name"]).agg(F.first("value"))
    said = tables.scrape(spark, f"{path}/*", {"region": r"region : (\d+)"})
    return pairs.join(said, "file").select(F.col("id").cast("long").alias("id"), "name", "region")


@query("SELECT n_nationkey AS id, 1 + n_nationkey * 10.5E0 AS ra, n_nationkey - 12.25E0 AS dec, CASE WHEN n_nationkey % 5 = 0 THEN 'EMPTY' WHEN n_nationkey % 5 = 1 THEN 'ERROR' ELSE 'OK' END AS status FROM nation")
def votables(spark, d):
    path = scratch(spark, "vot")
    info = F.when(F.col("n_nationkey") % 5 == 0, '<INFO name="QUERY_STATUS" value="ERROR">no object was found</INFO>').when(F.col("n_nationkey") % 5 == 1, '<INFO name="QUERY_STATUS" value="ERROR">overload</INFO>').otherwise('<INFO name="QUERY_STATUS" value="OK"/>')
    row = F.concat(F.lit("<TR><TD>"), F.col("n_nationkey").cast("string"), F.lit("</TD><TD>"), (1 + F.col("n_nationkey") * F.lit(10.5)).cast("string"), F.lit("</TD><TD>"), (F.col("n_nationkey") - F.lit(12.25)).cast("string"), F.lit("</TD></TR>"))
    xml = F.concat(F.lit('<VOTABLE xmlns="http://www.ivoa.net/xml/VOTable/v1.3"><RESOURCE>'), info, F.lit('<TABLE><FIELD name="id"/><FIELD ID="_raj2000" name="ra"/><FIELD name="_decj2000"/><DATA><TABLEDATA>'), row, F.lit("</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"))
    read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), xml.alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("k").text(path)
    found = votable.read_votables(spark, f"{path}/*")
    cells = votable.positions(votable.rows(found, ["id", "_raj2000", "_decj2000", "RA", "DEC"]))
    return cells.join(found.select("file", votable.status(F.col("xml")).alias("status")), "file").select(F.col("id").cast("long").alias("id"), "ra", "dec", "status")


@query("SELECT n_nationkey AS id, n_regionkey AS region FROM nation")
def ecsv_tables(spark, d):
    path = scratch(spark, "ecsv")
    lines = ["# %ECSV 1.0", "# ---", "# datatype:", "# - {name: id, datatype: int64}", "id region name"] + [f'{r["n_nationkey"]} {r["n_regionkey"]} "a b"' for r in read(spark, d, "nation").collect()]
    tables.write_text(spark, path, "\n".join(lines) + "\n")
    return tables.read_ecsv(spark, path).where("name = 'a b'").select(F.col("id").cast("long").alias("id"), F.col("region").cast("long").alias("region"))


_UPLOADED = "((c_custkey * 7919) % 360000) / 1000.0E0 AS ra, ((c_custkey * 104729) % 180000 - 90000) / 1000.0E0 AS dec"


@query(f"SELECT c_custkey AS id, {_UPLOADED}, (row_number() OVER (ORDER BY lpad(CAST(c_custkey AS STRING), 18, '0')) - 1) // 400 + 1 AS chunk FROM customer")
def upload_tables(spark, d):
    """One VOTable a chunk of 400 rows, written by the tasks, read back."""
    path = scratch(spark, "upload")
    rows = read(spark, d, "customer").selectExpr("lpad(CAST(c_custkey AS STRING), 18, '0') AS row_id", *_UPLOADED.split(", "))
    votable.write_uploads(rows, path, 400)
    back = votable.rows(votable.read_votables(spark, f"{path}/*"), ["row_id", "ra", "dec"])
    chunk = F.regexp_extract("file", "chunk=([0-9]+)", 1).cast("long")
    return back.select(F.col("row_id").cast("long").alias("id"), F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"), chunk.alias("chunk"))


@query("SELECT 'FIRST' AS stage, CAST(count(*) AS BIGINT) AS rows_in FROM customer UNION ALL SELECT 'SECOND', CAST(count(*) AS BIGINT) FROM orders")
def appended_ledger(spark, d):
    path = scratch(spark, "ledger")
    for stage, name in (("FIRST", "customer"), ("SECOND", "orders")):
        tables.append_ledger(read(spark, d, name).agg(F.lit(stage).alias("stage"), F.count("*").alias("rows_in")), path)
    return tables.read_csv(spark, path).select("stage", F.col("rows_in").cast("long").alias("rows_in"))


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1")
def lines_of_files(spark, d):
    path = scratch(spark, "counts")
    rows = read(spark, d, "customer").select("c_nationkey", "c_custkey").repartition(1)
    rows.write.option("header", True).partitionBy("c_nationkey").csv(path)
    counted = tables.row_counts(spark, f"{path}/*")
    return counted.select(F.regexp_extract("file", "c_nationkey=([0-9]+)", 1).cast("long").alias("nation"), "n")


@query(cte("det", "any") + """, k AS (SELECT *, median(FWHM_IMAGE) FILTER (WHERE NOT isnan(FWHM_IMAGE)) OVER (PARTITION BY tile_id) AS fm, median(ELONGATION) OVER (PARTITION BY tile_id) AS em FROM det WHERE FLAGS = 0 AND NOT isnan(SNR_WIN) AND SNR_WIN > 30),
s AS (SELECT *, 1.4826 * median(abs(FWHM_IMAGE - fm)) FILTER (WHERE NOT isnan(FWHM_IMAGE)) OVER (PARTITION BY tile_id) AS fs, 1.4826 * median(abs(ELONGATION - em)) OVER (PARTITION BY tile_id) AS es FROM k),
g AS (SELECT src_id, ra, dec FROM s WHERE NOT isnan(FWHM_IMAGE) AND (NOT fs > 0 OR abs(FWHM_IMAGE - fm) <= 2 * fs) AND (NOT es > 0 OR abs(ELONGATION - em) <= 2 * es) AND SPREAD_MODEL > -0.002 AND FWHM_IMAGE > 2 AND FWHM_IMAGE < 7 AND ELONGATION < 1.3 AND XMAX_IMAGE - XMIN_IMAGE > 1 AND YMAX_IMAGE - YMIN_IMAGE > 1 AND abs((XMAX_IMAGE - XMIN_IMAGE) - (YMAX_IMAGE - YMIN_IMAGE)) < 2),
t AS (SELECT cat_id, ra, dec, rmag FROM any_ WHERE rmag > 0 AND rmag <= 16), """ + f"p AS ({pair_cte('g', 't', 90.0, 'a.src_id, b.cat_id, b.rmag')}), n AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY s, cat_id) AS k FROM p) SELECT g.src_id FROM g LEFT JOIN n ON n.src_id = g.src_id AND n.k = 1 WHERE n.src_id IS NULL OR NOT (n.rmag <= 12.4 OR n.rmag < round(-0.09E0 * n.s + 15.3E0, 6))")
def late_filter_survivors(spark, d):
    stars = catalogue(spark, d).where("rmag > 0 AND rmag <= 16").withColumnRenamed("cat_id", "star_id")
    return composites.late_filters(detections(spark, d), stars)[0].select("src_id")


_GOOD = cte("gaia", "shots") + f", s AS (SELECT cat_id AS opt_source_id, ra, dec FROM gaia WHERE cat_id % 2 = 0), f AS (SELECT cntr, ra, dec FROM shots WHERE {GOOD_SHOT}), p AS ({pair_cte('s', 'f', 5.0, 'a.opt_source_id, b.cntr')})"


@query(_GOOD + " SELECT opt_source_id, arg_min(cntr, (s, cntr)) AS cntr, round(min(s), 6) AS sep FROM p GROUP BY 1")
def infrared_partners(spark, d):
    seeds = catalogue(spark, d, "gaia").where("cat_id % 2 = 0").selectExpr("cat_id AS opt_source_id", "ra", "dec")
    found = composites.infrared_sidecar(seeds, shots(spark, d).unionByName(shots(spark, d)))
    return found.select("opt_source_id", "cntr", F.round("sep_arcsec", 6).alias("sep"))


@query(_GOOD + " SELECT opt_source_id, arg_min(cntr, (s, cntr)) AS cntr, round(min(s), 6) AS sep FROM p GROUP BY 1")
def infrared_by_pixel(spark, d):
    """Exposures stored by pixel, then a join that leaves them in their buckets."""
    seeds = catalogue(spark, d, "gaia").where("cat_id % 2 = 0").selectExpr("cat_id AS opt_source_id", "ra", "dec")
    stored = pixels.write_catalogue(shots(spark, d), scratch(spark, "pixels"), order=8, buckets=None)
    return composites.infrared_by_pixel(seeds, stored).select("opt_source_id", "cntr", F.round("sep_arcsec", 6).alias("sep"))


@query(cte("det", "gaia") + f", p AS ({pair_cte('det', 'gaia', 5.0)}), o AS (SELECT src_id, min(s) AS s FROM p GROUP BY 1), r AS (SELECT unnest([1.0E0, 2.0E0, 5.0E0]) AS radius_arcsec) SELECT radius_arcsec, count(*) AS n_matched FROM o JOIN r ON s <= radius_arcsec GROUP BY 1")
def radii_compared(spark, d):
    return composites.compare_radii(detections(spark, d).select("src_id", "ra", "dec"), catalogue(spark, d, "gaia"), (1.0, 2.0, 5.0)).select("radius_arcsec", "n_matched")


@query(cte("det", "gaia", "ps1") + f", p AS ({pair_cte('det', 'gaia', 5.0)}), q AS ({pair_cte('det', 'ps1', 5.0)}) SELECT tile_id, count(*) AS n, count(*) FILTER (WHERE src_id IN (SELECT src_id FROM p) OR src_id IN (SELECT src_id FROM q)) AS matched FROM det GROUP BY 1")
def flags_of_catalogues(spark, d):
    found = stages.flag_stage(detections(spark, d).select("src_id", "tile_id", "ra", "dec"), {r: catalogue(spark, d, r) for r in ("gaia", "ps1")})
    return found.flags.groupBy("tile_id").agg(F.count("*").alias("n"), F.count_if("any_match").alias("matched"))


@query("SELECT 'old' AS side, count(*) AS n FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 EXCEPT SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 3 = 0) UNION ALL SELECT 'both', count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 INTERSECT SELECT DISTINCT c_nationkey FROM customer WHERE c_custkey % 3 = 0)")
def tile_sets(spark, d):
    a = read(spark, d, "supplier").where("s_suppkey % 2 = 0").selectExpr("s_nationkey AS tile").distinct()
    b = read(spark, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_nationkey AS tile").distinct()
    count = lambda rows, side: rows.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count(flags.unmatched(a, b, "tile"), "old").unionByName(count(a.intersect(b), "both"))


@query(cte("frames") + " SELECT event_id, dist_arcsec <= 2.0 AS strict FROM frames")
def strict_by_distance(spark, d):
    rows = frames(spark, d).select("event_id", "dist_arcsec")
    return rows.select("event_id", filters.strict_match(rows, 2.0).alias("strict"))


@query(cte("det") + " SELECT src_id, tile_id FROM (SELECT src_id, tile_id, row_number() OVER (PARTITION BY src_id ORDER BY tile_id) AS n FROM det) WHERE n = 1 ORDER BY src_id LIMIT 100")
def limited_in_order(spark, d):
    return cut(dedup.first_by(detections(spark, d).select("src_id", "tile_id"), ["src_id"], [F.col("tile_id")])).orderBy("src_id").limit(100)


_OUTCOMES = "concat('i', CAST(event_id % 700 AS STRING)) AS item, CASE event_id % 4 WHEN 0 THEN 'new' WHEN 3 THEN 'ok' ELSE 'failed' END AS outcome"


@query(f"""WITH e AS (SELECT {_OUTCOMES}, ts AS t FROM events), o AS (SELECT item, outcome, t FROM (SELECT *, row_number() OVER (PARTITION BY item, t ORDER BY outcome DESC) AS k FROM e WHERE outcome <> 'new') WHERE k = 1),
c AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (WHERE outcome = 'failed') OVER w AS failures FROM o WINDOW w AS (PARTITION BY item ORDER BY t)),
f AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY t) AS k FROM c WHERE outcome = 'ok' OR failures >= 3)
SELECT item, CASE WHEN outcome = 'ok' THEN 'done' ELSE 'given_up' END AS status, CAST(n AS INTEGER) AS attempts FROM f WHERE k = 1""")
def retried_items(spark, d):
    """Items that ended, from a stream of attempts with keyed state; each ends once."""
    source, out = scratch(spark, "attempts"), scratch(spark, "ended")
    read(spark, d, "events").selectExpr(*_OUTCOMES.rsplit(", CASE", 1)[:1], "CASE" + _OUTCOMES.rsplit(", CASE", 1)[1], "CAST(ts AS TIMESTAMP) AS at").write.parquet(source)
    events = spark.readStream.schema("item string, outcome string, at timestamp").parquet(source)
    each = retry.attempts(events, most=3).writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True)
    each.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
    return spark.read.parquet(out).where("status <> 'due'").select("item", "status", "attempts")
