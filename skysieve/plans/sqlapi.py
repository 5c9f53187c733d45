"""Funnels as SQL text: named functions for expressions, and views of sky joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skysieve.operators import skyjoin

#: SQL functions by signature and body; registered as temporary functions, expanded by the optimizer.
FUNCTIONS = {
    "sky_sep(ra1 DOUBLE, dec1 DOUBLE, ra2 DOUBLE, dec2 DOUBLE)": "RETURN degrees(2.0D * asin(sqrt(least(1.0D, greatest(0.0D, power(sin((radians(dec2) - radians(dec1)) / 2.0D), 2) + cos(radians(dec1)) * cos(radians(dec2)) * power(sin((radians(ra2) - radians(ra1)) / 2.0D), 2)))))) * 3600.0D",
    "sky_ra_bin(ra DOUBLE)": "RETURN CAST(floor(pmod(ra, 360.0D) / 5.0D) AS INT)",
    "sky_dec_bin(dec DOUBLE)": "RETURN CAST(floor((dec + 90.0D) / 5.0D) AS INT)",
    "sky_mjd(t TIMESTAMP)": "RETURN unix_micros(t) / 86400000000.0D + 40587.0D",
    "row_tile(row_id STRING)": "RETURN split_part(row_id, ':', 1)",
    "is_true(flag STRING)": "RETURN coalesce(lower(trim(flag)) IN ('true', 't', '1', 'yes', 'y'), false)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {_type(signature)} {body}")


def _type(signature: str) -> str:
    name = signature.split("(")[0]
    return {"sky_ra_bin": "INT", "sky_dec_bin": "INT", "row_tile": "STRING", "is_true": "BOOLEAN"}.get(name, "DOUBLE")


def view_pairs(spark: SparkSession, name: str, left: str, right: str, radius_arcsec: float) -> DataFrame:
    """A view of all pairs of two tables or views (columns ra, dec) within a radius."""
    found = skyjoin.pairs(spark.table(left), spark.table(right), radius_arcsec)
    found.createOrReplaceTempView(name)
    return found
