"""Small joins around positions and ids: cones, match reports, rounded keys, seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions import sky
from skysieve.functions.text import canonical_id
from skysieve.sources.schema import resolve

#: Where a matched id may stand, in order.
MATCHED_IDS = ("NUMBER", "number", "objectnumber", "object_id", "objID", "source_id", "row_id", "src_id", "id")
#: Columns of a matcher's output that come from the input, never from a hit.
INPUT_COLUMNS = ("src_id", "row_id", "NUMBER", "tile_id", "object_id", "ra", "dec")


def cone(catalogue: DataFrame, ra: float, dec: float, radius_arcsec: float) -> DataFrame:
    """Rows within a radius of one position with their separation; a declination band goes to the scan first."""
    band = radius_arcsec / 3600.0
    near = catalogue.where(F.col("dec").between(dec - band, dec + band))
    return near.withColumn("sep_arcsec", sky.sep_arcsec("ra", "dec", F.lit(ra), F.lit(dec))).where(F.col("sep_arcsec") <= radius_arcsec)


def nearest_in_cone(catalogue: DataFrame, ra: float, dec: float, radius_arcsec: float, key: str) -> DataFrame:
    """At most one row: the nearest, ties to the smaller key."""
    return cone(catalogue, ra, dec, radius_arcsec).orderBy("sep_arcsec", key).limit(1)


def match_report(rows: DataFrame, matched: DataFrame, key: str = "NUMBER") -> DataFrame:
    """`rows` with `matched`; ids are compared as canonical digits, whatever type or notation a side uses."""
    ids = matched.select(canonical_id(key).alias("__id")).where("__id IS NOT NULL").distinct().withColumn("matched", F.lit(True))
    named = rows.withColumn("__id", canonical_id(key)).join(ids, "__id", "left")
    return named.withColumn("matched", F.coalesce("matched", F.lit(False))).drop("__id")


def join_rounded(left: DataFrame, right: DataFrame, digits: int = 7, how: str = "inner") -> DataFrame:
    """Equality join on positions rounded to some decimals; right columns take the suffix _r."""
    r = right.withColumnsRenamed({c: f"{c}_r" for c in right.columns})
    same = (F.round(left["ra"], digits) == F.round(r["ra_r"], digits)) & (F.round(left["dec"], digits) == F.round(r["dec_r"], digits))
    return left.join(r, same, how)


def matched_ids(found: DataFrame, flag: str) -> DataFrame:
    """Distinct ids of a matcher's output with a true flag; no id column: no rows."""
    name = next((c for c in MATCHED_IDS if c in found.columns), None)
    if name is None:
        return found.limit(0).select(F.lit(None).cast("string").alias("NUMBER"), F.lit(True).alias(flag))
    return found.where(F.col(name).isNotNull()).select(F.col(name).alias("NUMBER")).distinct().withColumn(flag, F.lit(True))


def is_hit(columns: Sequence[str], distance: str | None = "angDist", inputs: Sequence[str] = INPUT_COLUMNS) -> Column:
    """Whether a left-best row has a partner: a finite distance, else anything in a column that isn't an input's."""
    if distance in columns:
        return sky.finite(F.col(distance).try_cast("double"))
    others = [c for c in columns if c not in inputs]
    out = F.lit(False)
    for c in others:
        out = out | (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return out


def seed(rows: DataFrame, profile: str = "neowise-opt") -> DataFrame:
    """(opt_source_id, ra, dec) of a master or chunk: tile and number, else image and number, else the number."""
    ra, dec = resolve(rows.columns, profile)
    number = F.col("NUMBER").cast("string")
    made = [F.concat(F.col(c), F.lit("#"), number) for c in ("tile_id", "image_id") if c in rows.columns]
    named = rows.select(F.coalesce(*made, number).alias("opt_source_id"), F.col(ra).cast("double").alias("ra"), F.col(dec).cast("double").alias("dec"))
    return named.where(sky.finite("ra", "dec"))


def with_epoch(rows: DataFrame, per_source: DataFrame | None = None, per_plate: DataFrame | None = None, constant: float | None = None) -> DataFrame:
    """`rows` with epoch_mjd from the first source there is: by src_id, by plate_id, or one constant."""
    out, found = rows, []
    for name, table, key in (("__s", per_source, "src_id"), ("__p", per_plate, "plate_id")):
        if table is not None:
            out = out.join(table.select(key, F.col("epoch_mjd").alias(name)), key, "left")
            found.append(F.col(name))
    value = F.coalesce(*found, F.lit(constant).cast("double"))
    return out.withColumn("epoch_mjd", value).drop("__s", "__p")
