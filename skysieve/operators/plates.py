"""Plates: header tables, epoch lookups, geometry reports, nearest and covering plates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions import sky
from skysieve.functions.sky import finite
from skysieve.functions.text import epoch_iso, epoch_timestamp, jd
from skysieve.operators import pyramid
from skysieve.operators.dedup import first_by
from skysieve.operators.skyjoin import estimated_bytes


class LookupFault(ValueError):
    """A lookup that should be many-to-one isn't, or misses keys."""


def unique_lookup(lookup: DataFrame, key: str) -> DataFrame:
    """`lookup`, after a check that no key repeats."""
    if not lookup.groupBy(key).count().where("count > 1").isEmpty():
        raise LookupFault(f"{key} repeats in the lookup")
    return lookup


def epoch_chain(rows: DataFrame, tile_to_plate: DataFrame, plate_epoch: DataFrame, validate: bool = True) -> DataFrame:
    """`rows` with plate_id, epoch_iso, epoch_jd through tile and plate; validated: keys are unique and none is missing."""
    if validate:
        tile_to_plate, plate_epoch = unique_lookup(tile_to_plate, "tile_id"), unique_lookup(plate_epoch, "plate_id")
    out = rows.join(tile_to_plate.select("tile_id", "plate_id"), "tile_id", "left").join(plate_epoch.select("plate_id", F.col("date_obs_iso").alias("epoch_iso"), F.col("jd").alias("epoch_jd")), "plate_id", "left")
    if validate and not out.where("plate_id IS NULL OR epoch_jd IS NULL").isEmpty():
        raise LookupFault("tiles without a plate or plates without an epoch")
    return out


def plate_epochs(headers: DataFrame, region: str = "REGION", date: str = "DATE-OBS") -> DataFrame:
    """(plate_id, date_obs_iso, jd): the earliest epoch of each plate."""
    rows = headers.select(F.trim(F.col(f"`{region}`")).alias("plate_id"), epoch_iso(F.col(f"`{date}`")).alias("date_obs_iso"), jd(epoch_timestamp(F.col(f"`{date}`"))).alias("jd"))
    rows = rows.where("plate_id <> '' AND date_obs_iso IS NOT NULL")
    return rows.groupBy("plate_id").agg(F.min_by(F.struct("date_obs_iso", "jd"), F.struct("date_obs_iso", "jd")).alias("e")).select("plate_id", "e.*")


def chosen_epoch(tile: Column, selected: Column, plate: Column) -> tuple[Column, Column]:
    """(ISO epoch, where it came from): tile header, then its selected part, then the plate header."""
    found = [epoch_iso(c) for c in (tile, selected, plate)]
    tag = F.when(found[0].isNotNull(), "tile_header").when(found[1].isNotNull(), "selected").when(found[2].isNotNull(), "plate_header")
    return F.coalesce(*found), tag


def plate_table(headers: DataFrame, order: str = "file") -> DataFrame:
    """One row a REGION, the first in file order, with centre and pixel scale."""
    rows = headers.where("REGION IS NOT NULL")
    rows = first_by(rows, ["REGION"], [F.col(order)])
    return rows.select(
        F.col("REGION").alias("plate_id"),
        F.col("PLATERA").cast("double").alias("ra0"),
        F.col("PLATEDEC").cast("double").alias("dec0"),
        F.col("NAXIS1").cast("int").alias("nx"),
        F.col("NAXIS2").cast("int").alias("ny"),
        sky.arcsec_per_pixel("PLTSCALE", "XPIXELSZ").alias("arcsec_x"),
        sky.arcsec_per_pixel("PLTSCALE", "YPIXELSZ").alias("arcsec_y"),
    )


def edge_report(tiles: DataFrame, plates: DataFrame, half_deg: float = 0.25) -> DataFrame:
    """(tile_id, plate_id, min_edge_dist_px, min_edge_dist_arcsec, class_px, class_arcsec): nine samples of each tile on its plate."""
    met = tiles.join(plates, "plate_id", "left")
    samples = F.array(*[F.struct(F.lit(i * half_deg).alias("x"), F.lit(j * half_deg).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    each = met.withColumn("s", F.explode(samples))
    ra, dec = sky.gnomonic_inverse(F.col("s.x"), F.col("s.y"), "ra", "dec")
    flip_x, flip_y = sky.orientation("ra0", "dec0", "nx", "ny", "arcsec_x", "arcsec_y")
    x, y = sky.plate_pixels(ra, dec, "ra0", "dec0", "nx", "ny", "arcsec_x", "arcsec_y", False, False)
    x, y = F.when(flip_x, F.col("nx") - x).otherwise(x), F.when(flip_y, F.col("ny") - y).otherwise(y)
    distances = each.withColumn("d", sky.signed_edge_distance(x, y, "nx", "ny"))
    worst = distances.groupBy("tile_id", "plate_id", "nx", "ny", "arcsec_x", "arcsec_y").agg(F.min("d").alias("min_edge_dist_px"))
    worst = worst.withColumn("min_edge_dist_arcsec", F.col("min_edge_dist_px") * (F.col("arcsec_x") + F.col("arcsec_y")) / 2.0)
    return worst.select("tile_id", "plate_id", "min_edge_dist_px", "min_edge_dist_arcsec", sky.edge_class_px("min_edge_dist_px", "nx", "ny").alias("class_px"), sky.edge_class_arcsec("min_edge_dist_arcsec").alias("class_arcsec"))


def nearest_plate(rows: DataFrame, plates: DataFrame, key: str, most_deg: float = 3.5) -> DataFrame:
    """`rows` with plate_id and plate_sep_deg of the nearest plate centre within the limit (null: none)."""
    ra, dec = sky.sanitize("ra", "dec")
    slim = rows.where(finite("ra", "dec")).select(F.col(key).alias("__id"), ra.alias("__lra"), dec.alias("__ldec"))
    best = pyramid.partners(slim, plates, "plate_id", ("ra0", "dec0"), most_deg=most_deg)
    return rows.join(best.select(F.col("__id").alias(key), F.col("__key").alias("plate_id"), (F.col("__sep") / 3600.0).alias("plate_sep_deg")), key, "left")


def plate_of_tile(tiles: DataFrame, plates: DataFrame, most_deg: float = 4.0, warn_deg: float = 1.0) -> DataFrame:
    """Region first (the preferred survey wins), else the nearest plate; nothing at `most_deg` or beyond."""
    by_region = first_by(plates, ["region"], [F.when(F.col("survey") == "POSSI-E", 0).otherwise(1), F.col("plate_id")])
    named = tiles.join(by_region.select("region", F.col("plate_id").alias("p_region")), "region", "left")
    rest = nearest_plate(named.where("p_region IS NULL").select("tile_id", "ra", "dec"), plates, "tile_id", most_deg).where(F.col("plate_sep_deg") < most_deg)
    out = named.join(rest.select("tile_id", F.col("plate_id").alias("p_near"), "plate_sep_deg"), "tile_id", "left")
    how = F.when(F.col("p_region").isNotNull(), "region").when(F.col("p_near").isNull(), "none").when(F.col("plate_sep_deg") >= warn_deg, "nearest_far").otherwise("nearest")
    return out.select(*tiles.columns, F.coalesce("p_region", "p_near").alias("plate_id"), "plate_sep_deg", how.alias("method"))


def covering_tile(rows: DataFrame, tiles: DataFrame, key: str, band_deg: float = 1.0) -> DataFrame:
    """`rows` with the tile whose footprint holds them; among several the least |dDec| + |dRA|, then the smaller name.

    `tiles`: tile_id, ra0, dec0, half_w, half_h (degrees; half_h <= band_deg). Declination bands and cells of ten degrees of
    RA give the equality key.
    """
    band = lambda c: F.floor((F.col(c) + 90.0) / band_deg).cast("int")
    right = tiles.withColumn("__band", F.explode(F.array(band("dec0") - 1, band("dec0"), band("dec0") + 1)))
    reach = F.least(F.lit(180.0), F.col("half_w") / F.greatest(F.lit(1e-6), F.cos(F.radians("dec0"))) + 1e-9)
    cells = F.sequence(F.floor((F.col("ra0") - reach) / 10.0), F.floor((F.col("ra0") + reach) / 10.0))
    right = right.withColumn("__cell", F.explode(F.array_distinct(F.transform(cells, lambda c: F.pmod(c, F.lit(36))))))
    left = rows.where(sky.finite("ra", "dec")).withColumn("__band", band("dec")).withColumn("__cell", F.floor(sky.wrap360("ra") / 10.0))
    met = left.join(right, ["__band", "__cell"]).where(sky.in_footprint("ra", "dec", "ra0", "dec0", "half_w", "half_h"))
    score = F.abs(F.col("dec") - F.col("dec0")) + F.abs(sky.wrap180(F.col("ra") - F.col("ra0")))
    others = [c for c in [*rows.columns, *tiles.columns] if c != key]
    return met.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(score.alias("s"), F.col("tile_id"))).alias("__t")).select(key, "__t.*")


def missing_plates(rows: DataFrame, held: DataFrame, plate: str = "plate_id") -> DataFrame:
    """(plate, n): candidates by plate that isn't held, most first."""
    return rows.where(F.col(plate).isNotNull()).join(held.select(plate).distinct(), plate, "left_anti").groupBy(plate).agg(F.count("*").alias("n")).orderBy(F.desc("n"), plate)


def overlapping_tiles(a: DataFrame, b: DataFrame, size_deg: float, least: float) -> DataFrame:
    """Pairs of tiles (a, b) whose shared area is at least a fraction (over 0) of a tile; `b` columns take the suffix _b.

    Zones are one tile high and a zone's RA cells as wide as two tiles' widths can reach there, so a tile meets its surroundings
    only. The smaller side is copied to the cells that it reaches.
    """
    other = b.withColumnsRenamed({c: f"{c}_b" for c in b.columns})
    top = F.least(F.lit(90.0), F.greatest(F.abs(F.col("__d") * size_deg - 90.0), F.abs((F.col("__d") + 1) * size_deg - 90.0)) + size_deg / 2.0 + 1e-9)
    reach = size_deg / F.greatest(F.lit(1e-12), F.cos(F.radians(top))) * (1 + 1e-9) + 1e-9
    n = F.when(top >= 89.999, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 / reach))).cast("long")
    zone = lambda dec: F.floor((dec + 90.0) / size_deg).cast("long")
    cell = lambda ra: F.pmod(F.floor(ra * n / 360.0).cast("long"), n)

    def dealt(rows: DataFrame, ra: str, dec: str, copies: bool) -> DataFrame:
        rows = rows.where(finite(ra, dec))
        if not copies:
            return rows.withColumn("__d", zone(F.col(dec))).withColumn("__r", cell(sky.wrap360(ra)))
        pad = size_deg * (1 + 1e-9) + 1e-9
        each = rows.withColumn("__d", F.explode(F.sequence(zone(F.col(dec) - pad), zone(F.col(dec) + pad))))
        return each.withColumn("__r", F.explode(F.array_distinct(F.array(*[cell(sky.wrap360(ra) + k * reach) for k in (-1, 0, 1)]))))

    copied = estimated_bytes(a) < estimated_bytes(b)
    met = dealt(a, "ra", "dec", copied).join(dealt(other, "ra_b", "dec_b", not copied), ["__r", "__d"]).withColumn("overlap", sky.overlap_fraction("ra", "dec", "ra_b", "dec_b", size_deg))
    return met.where(F.col("overlap") >= least).drop("__r", "__d")


def tessellated(plates: DataFrame, half_deg: float, step_deg: float, hexagonal: bool = False, coords: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """`plates` with row, column and the tile's ra, dec: a rectangular or hexagonal tessellation about every plate's centre.

    Plates are rows and each makes its own tiles, so the work grows and spreads with them. A plate without a finite centre has no tiles.
    """
    k = int(half_deg // step_deg)
    across = F.sequence(F.lit(-k), F.lit(k))
    each = plates.where(finite(*coords)).withColumnsRenamed({coords[0]: "__ra0", coords[1]: "__dec0"}).withColumn("row", F.explode(across)).withColumn("column", F.explode(across))
    height = step_deg * (3**0.5 / 2 if hexagonal else 1.0)
    eta = F.col("row") * height
    xi = (F.col("column") + (F.pmod(F.col("row"), F.lit(2)) * 0.5 if hexagonal else F.lit(0.0))) * step_deg
    ra, dec = sky.gnomonic_inverse(xi, eta, "__ra0", "__dec0")
    others = [c for c in plates.columns if c not in coords]
    return each.select(*others, F.col("row").cast("long").alias("row"), "column", ra.alias("ra"), dec.alias("dec"))


def plate_grid(spark, ra0: float, dec0: float, half_deg: float, step_deg: float, hexagonal: bool = False) -> DataFrame:
    """(row, column, ra, dec): rectangular or hexagonal centres of one plate's tessellation."""
    return tessellated(spark.createDataFrame([(ra0, dec0)], "ra double, dec double"), half_deg, step_deg, hexagonal)


def coverage_grid(spark, plates: DataFrame, step_deg: int = 5, radius_deg: float = 3.25) -> DataFrame:
    """(ra, dec, letter): class letter of the plate (plate_id, ra0, dec0, survey) nearest to each grid centre (dot: none)."""
    grid = spark.range(0, 360, step_deg).select(F.col("id").cast("double").alias("ra"), F.explode(F.sequence(F.lit(-90), F.lit(90), F.lit(step_deg))).alias("dec")).withColumn("dec", F.col("dec").cast("double"))
    grid = grid.withColumn("cell", F.concat_ws("/", "ra", "dec"))
    named = nearest_plate(grid, plates, "cell", radius_deg).join(plates.select("plate_id", "survey"), "plate_id", "left")
    from skysieve.functions.text import survey_class

    letter = F.when(F.col("plate_id").isNull(), ".").otherwise(F.substring(survey_class("survey"), 1, 1))
    return named.select("ra", "dec", letter.alias("letter"))
