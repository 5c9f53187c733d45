"""Sky tables derived from the data folder: the same expressions, as text, serve Spark and the SQL checks.

Positions use integer arithmetic and one division, so both engines get the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RA0 = "((k * 7919) % 3600000) / 10000.0E0"
DEC0 = "(((k * 104729) % 1600000) - 800000) / 10000.0E0"
NAN = "CAST('NaN' AS DOUBLE)"

DETECTIONS = (
    "concat_ws(':', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS src_id",
    "concat('tile-', CAST(l_suppkey % 40 AS STRING)) AS tile_id",
    "l_orderkey AS number",
    "CAST(l_suppkey % 25 AS INT) AS plate_no",
    f"{RA0.replace('k ', 'l_orderkey ')} + (((l_partkey * 31 + l_linenumber * 17) % 161) - 80) / 36000.0E0 AS ra",
    f"{DEC0.replace('k ', 'l_orderkey ')} + (((l_suppkey * 37 + l_linenumber * 13) % 161) - 80) / 36000.0E0 AS dec",
    "CAST(l_linenumber % 4 AS INT) AS FLAGS",
    f"CASE WHEN l_partkey % 97 = 0 THEN {NAN} ELSE l_quantity * 2 END AS SNR_WIN",
    f"CASE WHEN l_partkey % 89 = 0 THEN {NAN} ELSE 1.0E0 + (l_partkey % 70) / 10.0E0 END AS FWHM_IMAGE",
    "1.0E0 + ((l_suppkey * 7) % 40) / 100.0E0 AS ELONGATION",
    "(((l_partkey * 13) % 100) - 10) / 1000.0E0 AS SPREAD_MODEL",
    "CAST(l_partkey % 7 AS DOUBLE) AS XMAX_IMAGE",
    "0.0E0 AS XMIN_IMAGE",
    "CAST(l_suppkey % 7 AS DOUBLE) AS YMAX_IMAGE",
    "0.0E0 AS YMIN_IMAGE",
    f"CASE WHEN l_partkey % 83 = 0 THEN {NAN} ELSE 10.0E0 + (l_partkey % 90) / 10.0E0 END AS MAG_AUTO",
)
CATALOGUE = (
    "o_orderkey AS cat_id",
    f"{RA0.replace('k ', 'o_orderkey ')} AS ra",
    f"{DEC0.replace('k ', 'o_orderkey ')} AS dec",
    "CASE WHEN o_orderkey % 53 = 0 THEN -999.0E0 ELSE 8.0E0 + (o_orderkey % 90) / 10.0E0 END AS rmag",
    "CAST(o_orderkey % 5 AS INT) AS nDetections",
    "CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS INT) ELSE CAST(o_orderkey % 4 AS INT) END AS ngoodobs",
    "((o_orderkey % 2001) - 1000) * 1.0E0 AS pmra",
    "((o_orderkey % 1501) - 750) * 1.0E0 AS pmdec",
)
ROLES = {"gaia": "o_orderkey % 3 <> 0", "ps1": "o_orderkey % 5 = 0", "usno": "o_orderkey % 7 = 0", "any": "o_orderkey IS NOT NULL"}
#: Frames of a monitoring survey, one row an event.
FRAMES = (
    "event_id",
    "user_id",
    "CAST(event_id % 3 AS BIGINT) AS qual_frame",
    "(event_id % 11) / 10.0E0 AS qi_fact",
    "CAST((event_id % 13) - 2 AS DOUBLE) AS saa_sep",
    f"CASE WHEN event_id % 97 = 0 THEN {NAN} ELSE (event_id % 40) * 1.0E0 END AS w1snr",
    "59000.0E0 + (event_id % 400) / 2.0E0 AS mjd",
    "CASE WHEN event_id % 5 = 0 THEN '00' WHEN event_id % 5 = 1 THEN '0' WHEN event_id % 5 = 2 THEN '11' WHEN event_id % 5 = 3 THEN '01' ELSE '0 0' END AS moon_masked",
    "(event_id % 700) / 100.0E0 AS dist_arcsec",
    "value",
)

#: Single exposures of a survey, one a row of lineitem; every gate drops some.
SHOTS = (
    "l_orderkey * 100000000000 + l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS cntr",
    DETECTIONS[4],
    DETECTIONS[5],
    "CAST(l_linenumber % 4 AS BIGINT) AS qual_frame",
    "(l_partkey % 11) / 10.0E0 AS qi_fact",
    "CAST((l_suppkey % 13) - 2 AS DOUBLE) AS saa_sep",
    f"CASE WHEN l_partkey % 97 = 0 THEN {NAN} ELSE l_quantity END AS w1snr",
    "59000.0E0 + (l_partkey % 250) AS mjd",
    "CASE WHEN l_suppkey % 5 = 0 THEN '00' WHEN l_suppkey % 5 = 1 THEN '0' WHEN l_suppkey % 5 = 2 THEN '11' WHEN l_suppkey % 5 = 3 THEN '01' ELSE '0 0' END AS moon_masked",
)
#: The gates of an exposure, as SQL.
GOOD_SHOT = "qual_frame > 0 AND qi_fact > 0 AND saa_sep > 0 AND NOT isnan(w1snr) AND w1snr >= 5 AND mjd <= 59198 AND moon_masked IN ('00', '0', '0 0')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*DETECTIONS)


def catalogue(spark: SparkSession, sf_dir: str, role: str = "any") -> DataFrame:
    return read(spark, sf_dir, "orders").where(ROLES[role]).selectExpr(*CATALOGUE)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*SHOTS)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*FRAMES)


def cte(*names: str) -> str:
    """WITH clause of the tables by name: det, gaia, ps1, usno, any, frames."""
    source = {"det": f"SELECT {', '.join(DETECTIONS)} FROM lineitem", "frames": f"SELECT {', '.join(FRAMES)} FROM events", "shots": f"SELECT {', '.join(SHOTS)} FROM lineitem"}
    source |= {r: f"SELECT {', '.join(CATALOGUE)} FROM orders WHERE {w}" for r, w in ROLES.items()}
    return "WITH " + ", ".join(f"{'any_' if n == 'any' else n} AS ({source[n]})" for n in names)


def sep(a: str, b: str, ra: str = "ra", dec: str = "dec") -> str:
    """Separation in arcseconds of two aliases, as SQL."""
    u, v = f"sin((radians({b}.{dec}) - radians({a}.{dec})) / 2.0E0)", f"sin((radians({b}.{ra}) - radians({a}.{ra})) / 2.0E0)"
    h = f"{u} * {u} + cos(radians({a}.{dec})) * cos(radians({b}.{dec})) * ({v} * {v})"
    return f"(degrees(2.0E0 * asin(sqrt(least(1.0E0, greatest(0.0E0, {h}))))) * 3600.0E0)"


def pair_cte(left: str, right: str, radius: float, keys: str = "a.src_id, b.cat_id") -> str:
    """SELECT of all pairs within the radius with column s."""
    band = radius / 3600.0 + 1e-9
    return f"SELECT {keys}, {sep('a', 'b')} AS s FROM {left} a JOIN {right} b ON b.dec >= a.dec - {band!r} AND b.dec <= a.dec + {band!r} WHERE {sep('a', 'b')} <= {radius}"
