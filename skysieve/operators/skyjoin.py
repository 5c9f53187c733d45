"""Joins on the sphere.

A radius becomes declination zones of several radii and RA cells whose width is safe for the largest |Dec| of a zone. One
side keeps its own cell; the other is copied to the cells that its circle reaches, which is one cell for most rows, and
the pair is found by an equality join on (zone, cell) with the exact separation as a filter. So the plan is a hash or
sort-merge join that adaptive execution can broadcast or split, never a nested loop. The smaller side is the one that is
copied, by the optimizer's size estimate unless the caller says. Rows whose position isn't finite have no partner.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysieve.functions.sky import finite, sanitize, sep_arcsec
from skysieve.session import cut

ZONE, CELL = "__zone", "__cell"


#: Radii of a zone's height and a cell's width; one beyond WIDE degrees.
FACTOR, WIDE = 8.0, 0.5


def _zone_cells(zone: Column, height: float, radius: float, factor: float) -> tuple[Column, Column]:
    """(number of RA cells, RA reach of the radius in degrees) of a zone: functions of the zone alone, so both sides agree."""
    top = F.least(F.lit(90.0), F.greatest(F.abs(zone * height - 90.0), F.abs((zone + 1) * height - 90.0)))
    near_pole = (top + radius >= 89.999) | (F.cos(F.radians(top)) <= math.sin(math.radians(min(radius, 90.0))))
    ratio = F.least(F.lit(1.0), math.sin(math.radians(min(radius, 90.0))) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12)))
    reach = F.degrees(F.asin(ratio)) * (1 + 1e-9) + 1e-9
    return F.when(near_pole, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 / (factor * reach)))).cast("long"), reach


def zoned(df: DataFrame, coords: tuple[str, str], radius_arcsec: float, copies: bool, factor: float = FACTOR) -> DataFrame:
    """`df` with its finite rows dealt to (zone, cell); `copies` to every zone and cell that the radius reaches."""
    radius = radius_arcsec / 3600.0
    factor = factor if radius <= WIDE else 1.0
    # more than the pad below, so that no zone lies between a row's own and the one its circle ends in
    height = max(factor * radius * (1 + 1e-8) + 1e-8, 1.0 / 3600.0)
    ra, dec = sanitize(*coords)
    df = df.where(finite(*coords))
    # keys that can't be null: else the planner infers null tests of them and works them out again in a filter
    known = lambda x: F.coalesce(x.cast("long"), F.lit(0).cast("long"))
    zone_of = lambda d: known(F.floor((d + 90.0) / height))
    if not copies:
        zone = df.withColumn(ZONE, zone_of(dec))
        n, _ = _zone_cells(F.col(ZONE), height, radius, factor)
        return zone.withColumn(CELL, known(F.pmod(F.floor(ra * n / 360.0).cast("long"), n)))
    # Both ranges have no gap: a zone is higher than the pad, and a cell as wide as the reach. Ends, counts and reaches are
    # columns below the generators, worked out once; within them each cell would repeat them in code too long to be compiled.
    pad = radius * (1 + 1e-9) + 1e-9
    zone = df.withColumn(ZONE, F.explode(F.sequence(zone_of(dec - pad), zone_of(dec + pad))))
    n, reach = _zone_cells(F.col(ZONE), height, radius, factor)
    sized = zone.select("*", ra.alias("__x"), known(n).alias("__n"), reach.alias("__reach"))
    edge = lambda x: known(F.floor(x * F.col("__n") / 360.0))
    ends = sized.select("*", edge(F.col("__x") - F.col("__reach")).alias("__west"), edge(F.col("__x") + F.col("__reach")).alias("__east"))
    cells = F.sequence(F.col("__west"), F.least(F.col("__east"), F.col("__west") + F.col("__n") - 1))
    whole = ends.withColumn(CELL, F.explode(cells)).withColumn(CELL, known(F.pmod(CELL, "__n")))
    return whole.drop("__x", "__n", "__reach", "__west", "__east")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pairs(left: DataFrame, right: DataFrame, radius_arcsec: float, left_coords: tuple[str, str] = ("ra", "dec"), right_coords: tuple[str, str] = ("ra", "dec"), suffixes: tuple[str, str] = ("_1", "_2"), sep: str = "sep_arcsec", copy: str = "auto") -> DataFrame:
    """All pairs within the radius with their separation; clashing names take the suffixes. `copy`: left, right or auto."""
    clash = set(left.columns) & set(right.columns)
    l_name = {c: c + suffixes[0] if c in clash else c for c in left.columns}
    r_name = {c: c + suffixes[1] if c in clash else c for c in right.columns}
    a, b = left.withColumnsRenamed(l_name), right.withColumnsRenamed(r_name)
    lc, rc = tuple(l_name[c] for c in left_coords), tuple(r_name[c] for c in right_coords)
    left_copied = copy == "left" or copy == "auto" and estimated_bytes(left) < estimated_bytes(right)
    met = zoned(a, lc, radius_arcsec, left_copied).join(zoned(b, rc, radius_arcsec, not left_copied), [ZONE, CELL])
    return met.withColumn(sep, sep_arcsec(*lc, *rc)).where(F.col(sep) <= radius_arcsec).drop(ZONE, CELL)


def best_right(found: DataFrame, left_key: str | Sequence[str], right_key: str, sep: str = "sep_arcsec") -> DataFrame:
    """The nearest partner of each left row; ties go to the smaller right key. One aggregate with map-side combine."""
    keys = [left_key] if isinstance(left_key, str) else [*left_key]
    others = [c for c in found.columns if c not in keys]
    order = F.struct(F.col(sep), F.col(right_key))
    return found.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in others])


def match_best(left: DataFrame, right: DataFrame, radius_arcsec: float, left_key: str, right_key: str, **how) -> DataFrame:
    """One best right row for each left row that has any within the radius."""
    return best_right(pairs(left, right, radius_arcsec, **how), left_key, right_key)


def symmetric(found: DataFrame, left_key: str, right_key: str, sep: str = "sep_arcsec") -> DataFrame:
    """One-to-one pairing, greedy by (separation, left key, right key).

    Each round keeps the pairs that are best for both of their ends and drops every pair that shares an end with one.
    """
    left, done = cut(found), None
    order = [F.col(sep), F.col(left_key), F.col(right_key)]
    while True:
        a, b = Window.partitionBy(left_key).orderBy(*order), Window.partitionBy(right_key).orderBy(*order)
        chosen = cut(left.withColumn("__a", F.row_number().over(a)).withColumn("__b", F.row_number().over(b)).where("__a = 1 AND __b = 1").drop("__a", "__b"))
        done = chosen if done is None else done.unionByName(chosen)
        rest = left.join(chosen.select(left_key), left_key, "left_anti").join(chosen.select(right_key), right_key, "left_anti")
        left = cut(rest.select(*found.columns))
        if left.isEmpty():
            return done


def match_symmetric(left: DataFrame, right: DataFrame, radius_arcsec: float, left_key: str, right_key: str, **how) -> DataFrame:
    """Pairs within the radius where each row of either side occurs once at most."""
    return symmetric(pairs(left, right, radius_arcsec, **how), left_key, right_key)


def _near_keys(left: DataFrame, right: DataFrame, radius_arcsec: float, key: str, left_coords: tuple[str, str], right_coords: tuple[str, str]) -> DataFrame:
    slim = right.select(F.col(right_coords[0]).alias("__ra"), F.col(right_coords[1]).alias("__dec"))
    return pairs(left.select(F.col(key), F.col(left_coords[0]).alias("__lra"), F.col(left_coords[1]).alias("__ldec")), slim, radius_arcsec, ("__lra", "__ldec"), ("__ra", "__dec"))


def semi(left: DataFrame, right: DataFrame, radius_arcsec: float, key: str, left_coords: tuple[str, str] = ("ra", "dec"), right_coords: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """Left rows with any right row within the radius."""
    return left.join(_near_keys(left, right, radius_arcsec, key, left_coords, right_coords).select(key), key, "left_semi")


def anti(left: DataFrame, right: DataFrame, radius_arcsec: float, key: str, left_coords: tuple[str, str] = ("ra", "dec"), right_coords: tuple[str, str] = ("ra", "dec"), mode: str = "any", right_key: str | None = None) -> DataFrame:
    """Left rows that carry on: mode `any` drops those with a partner within the radius, `best` those in a one-to-one pair."""
    if mode == "best":
        mine = left.select(key, *left_coords)
        other = right.select(F.col(right_key).alias("__key"), F.col(right_coords[0]).alias("__ra"), F.col(right_coords[1]).alias("__dec"))
        hit = match_symmetric(mine, other, radius_arcsec, key, "__key", left_coords=left_coords, right_coords=("__ra", "__dec"))
    else:
        hit = _near_keys(left, right, radius_arcsec, key, left_coords, right_coords)
    return left.join(hit.select(key), key, "left_anti")


def count_within(left: DataFrame, right: DataFrame, radius_arcsec: float, key: str, left_coords: tuple[str, str] = ("ra", "dec"), right_coords: tuple[str, str] = ("ra", "dec"), name: str = "matched_count", least: str | None = None) -> DataFrame:
    """Every left row with the number of right rows within the radius, and their least separation if `least` names it."""
    near = _near_keys(left, right, radius_arcsec, key, left_coords, right_coords)
    wanted = [F.count("*").alias(name)] + ([F.min("sep_arcsec").alias(least)] if least else [])
    return left.join(near.groupBy(key).agg(*wanted), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_coords: tuple[str, str] = ("ra", "dec"), right_coords: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """The nearest right row of every left row at whatever distance, by a pyramid of cells (see operators.pyramid)."""
    from skysieve.operators import pyramid

    return pyramid.nearest(left, right, left_key, right_key, left_coords, right_coords)


def multi_radius(found: DataFrame, radii: Sequence[float], total: Column | int, sep: str = "sep_arcsec") -> DataFrame:
    """(radius_arcsec, n_matched, rate) of one nearest-neighbour table, in one pass."""
    each = found.select(F.explode(F.array(*[F.when(F.col(sep) <= r, F.lit(float(r))) for r in radii])).alias("radius_arcsec"))
    counted = each.where("radius_arcsec IS NOT NULL").groupBy("radius_arcsec").agg(F.count("*").alias("n_matched"))
    return counted.withColumn("rate", F.col("n_matched") / (total if isinstance(total, Column) else F.lit(total)))
