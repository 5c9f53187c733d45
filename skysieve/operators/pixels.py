"""Catalogues stored by sky pixel, and joins that leave them where they are.

A catalogue is written once as a table that is partitioned by leaf (a coarse nested pixel, one folder each) and bucketed
by pixel, sorted within. A join copies each seed to the pixels that its circle can reach, which is its own pixel unless
its border is near, and meets the catalogue by an equality join on the pixel: seeds move to the buckets, the catalogue has no Exchange.
The leaves that the copied seeds need are known before the read, so other folders are not listed or opened.

Rows whose position isn't finite are not stored and have no partner. A pixel is a key: the order should be fine enough that one pixel's rows
are few, as identical positions are the only rows that a finer order can't part.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions import sky
from skysieve.functions.sky import finite, sanitize, sep_arcsec
from skysieve.operators.skyjoin import best_right, estimated_bytes
from skysieve.sources.tables import write_text

LEAF, PIXEL = "leaf", "pixel"
#: In-face pixel widths that a radian on the sky spans at most, at order 0: sqrt(6) / 2 in declination and 1.73 / 2 across, so 1.5 in all.
STRETCH = 1.5


def with_pixel(df: DataFrame, order: int, coords: tuple[str, str] = ("ra", "dec"), name: str = PIXEL) -> DataFrame:
    """The finite rows of `df` with their nested pixel."""
    ra, dec = sanitize(*coords)
    return df.where(finite(*coords)).withColumn(name, sky.healpix_nested(ra, dec, order))


def neighbours(df: DataFrame, pixel: str, order: int, to: str = "neighbour") -> DataFrame:
    """A row for each pixel, up to eight, that shares a side or a corner with the row's, over face borders too.

    Steps are taken in the face; beyond its border the face that follows is known from the ring of faces (north, equator,
    south), and where polar faces meet, coordinates turn.
    """
    n, last = 1 << order, (1 << (2 * order)) - 1
    inner = F.col(pixel).bitwiseAND(last)
    x, y = sky.every_second_bit(inner), sky.every_second_bit(F.shiftright(inner, 1))
    at = df.withColumns({"__face": F.shiftright(F.col(pixel), 2 * order), "__x": x, "__y": y})
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("u"), F.lit(b).alias("v")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    at = at.withColumn("__step", step).withColumns({"__u": F.col("__x") + F.col("__step.u"), "__v": F.col("__y") + F.col("__step.v")})
    side = lambda c: F.when(c < 0, -1).when(c >= n, 1).otherwise(0)
    at = at.withColumns({"__a": side(F.col("__u")), "__b": side(F.col("__v")), "__u": F.pmod("__u", F.lit(n)), "__v": F.pmod("__v", F.lit(n)), "__ring": F.floor(F.col("__face") / 4), "__lane": F.pmod("__face", F.lit(4))})
    over = lambda a, b: (F.col("__a") == a) & (F.col("__b") == b)
    lane = lambda k, base=0: F.pmod(F.col("__lane") + k, F.lit(4)) + base
    north = F.when(over(-1, -1), lane(0, 8)).when(over(-1, 0), lane(0, 4)).when(over(0, -1), lane(1, 4)).when(over(1, 0), lane(1)).when(over(0, 1), lane(3)).when(over(1, 1), lane(2))
    equator = F.when(over(1, -1), lane(1, 4)).when(over(-1, 1), lane(3, 4)).when(over(-1, 0), lane(3, 8)).when(over(0, -1), lane(0, 8)).when(over(1, 0), lane(0)).when(over(0, 1), lane(3))
    south = F.when(over(1, 1), lane(0)).when(over(1, 0), lane(1, 4)).when(over(0, 1), lane(0, 4)).when(over(-1, 0), lane(3, 8)).when(over(0, -1), lane(1, 8)).when(over(-1, -1), lane(2, 8))
    face = F.when(over(0, 0), F.col("__face")).otherwise(F.when(F.col("__ring") == 0, north).when(F.col("__ring") == 1, equator).otherwise(south))
    # polar faces turn where they meet each other: half a turn over the pole, a quarter over a side
    cap, inward = F.col("__ring") != 1, F.when(F.col("__ring") == 0, 1).otherwise(-1)
    half = cap & (F.col("__a") == inward) & (F.col("__b") == inward)
    by_x = cap & (F.col("__a") == inward) & (F.col("__b") == 0)
    by_y = cap & (F.col("__a") == 0) & (F.col("__b") == inward)
    back = lambda c: F.lit(n - 1) - F.col(c)
    i = F.when(half, back("__u")).when(by_x, F.col("__v")).when(by_y, back("__v")).otherwise(F.col("__u"))
    j = F.when(half, back("__v")).when(by_x, back("__u")).when(by_y, F.col("__u")).otherwise(F.col("__v"))
    at = at.withColumns({"__f": face, "__i": i.cast("long"), "__j": j.cast("long")}).where("__f IS NOT NULL")
    found = at.withColumn(to, F.shiftleft(F.col("__f").cast("long"), 2 * order) + sky.interleave(F.col("__i"), F.col("__j")))
    return found.select(*df.columns, to).distinct() if order == 0 else found.select(*df.columns, to)


def reached(seeds: DataFrame, radius_arcsec: float, order: int, coords: tuple[str, str] = ("ra", "dec"), name: str = PIXEL) -> DataFrame:
    """The finite seeds, copied to every pixel that a circle of the radius can reach: one for most."""
    width = STRETCH * (1 << order) * math.radians(radius_arcsec / 3600.0) * (1 + 1e-9) + 1e-9
    if width >= 1.0:
        raise ValueError(f"a radius of {radius_arcsec} arcsec is too wide for pixels of order {order}")
    ra, dec = sanitize(*coords)
    face, x, y = sky.healpix_face(ra, dec, order)
    at = with_pixel(seeds, order, coords, name).withColumns({"__x": x, "__y": y})
    away = lambda c: F.least(F.col(c) - F.floor(c), F.floor(c) + 1 - F.col(c))
    at = at.withColumn("__near", F.least(away("__x"), away("__y")) <= width).drop("__x", "__y")
    more = neighbours(at.where("__near"), name, order, "__to").withColumn(name, F.col("__to")).drop("__to")
    return at.unionByName(more).drop("__near")


@dataclass(frozen=True)
class PixelCatalogue:
    """A stored catalogue: where it is and how it is laid out."""

    path: str
    name: str
    order: int
    leaf_order: int
    buckets: int
    ddl: str

    def table(self, spark: SparkSession) -> DataFrame:
        """The stored rows; the session learns of the table where it doesn't know it yet."""
        if not spark.catalog.tableExists(self.name):
            spark.sql(f"CREATE TABLE {self.name} ({self.ddl}) USING parquet OPTIONS (path '{self.path}') PARTITIONED BY ({LEAF}) CLUSTERED BY ({PIXEL}) SORTED BY ({PIXEL}) INTO {self.buckets} BUCKETS")
            spark.catalog.recoverPartitions(self.name)
        return spark.table(self.name)

    def leaves_of(self, pixels: DataFrame, name: str = PIXEL) -> list[int]:
        """The leaves of the given pixels: 12 x 4^leaf_order numbers at most."""
        leaf = F.shiftright(F.col(name), 2 * (self.order - self.leaf_order)).cast("int")
        return sorted(r[0] for r in pixels.select(leaf.alias("l")).distinct().collect())

    def read(self, spark: SparkSession, leaves: Sequence[int] | None = None) -> DataFrame:
        """The stored rows of some leaves, or of all."""
        rows = self.table(spark)
        return rows if leaves is None else rows.where(F.col(LEAF).isin([int(x) for x in leaves]))


def buckets_for(size: int, least: int = 8, each: int = 32 << 20, most: int = 4096) -> int:
    """Buckets of a table of `size` bytes: `each` bytes a bucket, so a task that writes or joins one doesn't grow with the table."""
    return max(least, min(most, -(-size // each)))


def write_catalogue(df: DataFrame, path: str, order: int = 8, leaf_order: int = 0, buckets: int | None = 64, coords: tuple[str, str] = ("ra", "dec")) -> PixelCatalogue:
    """Stores `df` by leaf and pixel below `path`, with its layout beside it, and returns the layout; no `buckets`: by the estimated size."""
    buckets = buckets or buckets_for(estimated_bytes(df))
    spark, name = df.sparkSession, f"pixels_{uuid.uuid4().hex}"
    rows = with_pixel(df, order, coords).withColumn(LEAF, F.shiftright(F.col(PIXEL), 2 * (order - leaf_order)).cast("int"))
    dealt = rows.repartition(buckets, PIXEL)  # by the buckets' own hash: a task writes one bucket, a file a leaf
    dealt.write.partitionBy(LEAF).bucketBy(buckets, PIXEL).sortBy(PIXEL).option("path", path).format("parquet").saveAsTable(name)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = PixelCatalogue(path, name, order, leaf_order, buckets, ddl)
    write_text(spark, f"{path}.layout.json", json.dumps(asdict(out)))
    return out


def open_catalogue(spark: SparkSession, path: str) -> PixelCatalogue:
    """A catalogue that another session has stored."""
    (row,) = spark.read.text(f"{path}.layout.json", wholetext=True).collect()
    return PixelCatalogue(**json.loads(row[0]))


def pixel_pairs(seeds: DataFrame, catalogue: PixelCatalogue, radius_arcsec: float, coords: tuple[str, str] = ("ra", "dec"), stored_coords: tuple[str, str] = ("ra", "dec"), gate: Callable[[DataFrame], DataFrame] | None = None, columns: Sequence[str] | None = None, suffix: str = "_c", sep: str = "sep_arcsec") -> DataFrame:
    """Pairs of seeds and stored rows within the radius; stored names that clash take the suffix.

    `gate` filters stored rows before they meet, so its conditions reach the scan; `columns` prunes it.
    """
    spark = seeds.sparkSession
    copied = reached(seeds, radius_arcsec, catalogue.order, coords, "__pixel")
    stored = catalogue.read(spark, catalogue.leaves_of(copied, "__pixel"))
    if gate is not None:
        stored = gate(stored)
    wanted = [c for c in (columns or stored.columns) if c not in (LEAF, PIXEL)]
    wanted += [c for c in stored_coords if c not in wanted]
    new = {c: c + suffix if c in seeds.columns else c for c in wanted}
    right = stored.select(PIXEL, *wanted).withColumnsRenamed(new)
    met = copied.join(right, F.col("__pixel") == F.col(PIXEL)).drop("__pixel", PIXEL)
    return met.withColumn(sep, sep_arcsec(*coords, *[new[c] for c in stored_coords])).where(F.col(sep) <= radius_arcsec)


def pixel_nearest(seeds: DataFrame, catalogue: PixelCatalogue, radius_arcsec: float, key: str, stored_key: str, **how) -> DataFrame:
    """The nearest stored row of each seed within the radius; ties to the smaller stored key."""
    return best_right(pixel_pairs(seeds, catalogue, radius_arcsec, **how), key, stored_key)
