"""Nearest partner at whatever distance, by a pyramid of sky cells.

The right side's distinct positions are counted by nested pixels, level by level; a cell with at most LEAF positions is a leaf, a heavier one has its
children on the next level, so the pyramid is deep only where positions crowd. The left side is dealt to cells of one level, about one for each right
position, and cells descend the pyramid, not rows. Each round replaces a left cell's right cells by their children, takes the least of the
farthest distances that they allow, and drops every right cell that begins beyond it; the round is an equality join on the parent cell and a
minimum for each left cell. The positions of the leaves that are left, filtered once more, become one short list a left cell, and a row meets its
cell's list where it lies: rows move once, and no pair of rows does. Left cells that keep more than MANY leaves (crowds that are far away) go
on row by row through the same rounds. No radius is guessed and none grows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysieve.functions import sky
from skysieve.functions.sky import finite, sanitize, sep_arcsec, sep_degrees
from skysieve.session import cut

#: Positions of a leaf at most, the deepest level (0.012 arcseconds wide), the levels that one pass counts, and the leaves of a left cell's list.
LEAF, DEEPEST, BAND, MANY = 8, 24, 8, 256


def build(right: DataFrame, key: str, coords: tuple[str, str] = ("ra", "dec"), leaf: int = LEAF) -> tuple[list[DataFrame], DataFrame]:
    """(cells of each level: pixel, parent, centre, reach, leaf; positions: ra, dec, key, level and pixel of their leaf).

    Rows of one position are one, that with the smallest key. A cell of the deepest level is a leaf whatever it holds. A
    pass counts the cells of BAND levels in one aggregate with map-side combine; only positions in cells that are still too heavy go on.
    """
    ra, dec = sanitize(*coords)
    rows = right.where(finite(*coords)).select(ra.alias("__ra"), dec.alias("__dec"), F.col(key).alias("__key"))
    rows = rows.groupBy("__ra", "__dec").agg(F.min("__key").alias("__key"))
    rest = cut(rows.withColumn("__fine", sky.healpix_nested("__ra", "__dec", DEEPEST)))
    at = F.expr(f"shiftright(__fine, 2 * ({DEEPEST} - __level))")
    levels, placed = [], None
    for first in range(0, DEEPEST + 1, BAND):
        last = min(DEEPEST, first + BAND - 1)
        each = rest.withColumn("__level", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("pixel", at)
        light = (F.col("n") <= leaf) | (F.col("__level") == DEEPEST)
        counted = cut(each.groupBy("__level", "pixel").agg(F.count("*").alias("n")).withColumn("__leaf", light))
        found = each.join(counted.where("__leaf").select("__level", "pixel"), ["__level", "pixel"], "left_semi").groupBy("__ra", "__dec").agg(F.min("__level").alias("__level"))
        marked = cut(rest.join(found, ["__ra", "__dec"], "left"))
        done = marked.where("__level IS NOT NULL").select("__ra", "__dec", "__key", "__level", at.alias("__pixel"))
        placed = done if placed is None else placed.unionByName(done)
        rest = marked.where("__level IS NULL").select("__ra", "__dec", "__key", "__fine")
        deepest, open_ = marked.agg(F.max("__level"), F.count_if(F.col("__level").isNull())).first()
        for level in range(first, (last if open_ or deepest is None else deepest) + 1):
            centre = sky.healpix_centre(F.col("pixel"), level)
            here = counted.where(F.col("__level") == level)
            levels.append(here.select("pixel", F.shiftright("pixel", 2).alias("parent"), centre[0].alias("__cra"), centre[1].alias("__cdec"), F.lit(sky.healpix_reach(level)).alias("__reach"), "__leaf"))
        if not open_:
            break
    return levels, placed


def leaves_within_reach(left: DataFrame, key: str, levels: list[DataFrame], slack: float = 0.0, most_deg: float | None = None) -> DataFrame:
    """(key, __lra, __ldec, __level, __pixel): for each row of (key, __lra, __ldec) the leaves that may hold its nearest position.

    With `slack` the row stands for all places within so many degrees; beyond `most_deg` nothing is kept.
    """
    base = [r["pixel"] for r in levels[0].select("pixel").collect()]  # 12 at most
    open_, held = left.withColumn("parent", F.explode(F.array(*[F.lit(p).cast("long") for p in base]).cast("array<bigint>"))), None
    nearest = Window.partitionBy(key)
    for level, cells in enumerate(levels):
        met = open_.join(cells, open_["parent"] == cells["pixel"]) if level == 0 else open_.join(cells, "parent")
        away, spread = sep_degrees("__lra", "__ldec", "__cra", "__cdec"), F.col("__reach") + (slack + 1e-9)
        met = met.withColumn("__away", away).select(key, "__lra", "__ldec", "__leaf", F.lit(level).alias("__level"), F.col("pixel").alias("__pixel"), (F.col("__away") - spread).alias("__low"), (F.col("__away") + spread).alias("__high"))
        if most_deg is not None:
            met = met.where(F.col("__low") <= most_deg)
        every = met if held is None else met.unionByName(held)
        kept = cut(every.withColumn("__most", F.min("__high").over(nearest)).where("__low <= __most").drop("__most"))
        held = kept.where("__leaf")
        open_ = kept.where("NOT __leaf").select(key, "__lra", "__ldec", F.col("__pixel").alias("parent"))
    return held.select(key, "__lra", "__ldec", "__level", "__pixel")


def partners(left: DataFrame, right: DataFrame, right_key: str, right_coords: tuple[str, str], leaf: int = LEAF, many: int = MANY, most_deg: float | None = None) -> DataFrame:
    """(__id, __key, __ra, __dec, __sep): the nearest position, in arcseconds, of every id of (__id, __lra, __ldec), ties to the smaller key.

    An id of several rows has the nearest of all; with `most_deg` ids without a position within so many degrees are left out.
    """
    levels, placed = build(right, right_key, right_coords, leaf)
    level = max(0, min(DEEPEST, round(math.log(max(1, placed.count()) / 12.0, 4)))) if not placed.isEmpty() else 0
    slack = sky.healpix_reach(level)
    x, y, z = sky.unit_xyz("__lra", "__ldec")
    rows = left.withColumns({"__cell": sky.healpix_nested("__lra", "__ldec", level), "__x": x, "__y": y, "__z": z})
    centre = sky.healpix_centre(F.col("__cell"), level)
    cells = rows.select("__cell").distinct().select("__cell", centre[0].alias("__lra"), centre[1].alias("__ldec"))
    near = cut(leaves_within_reach(cells, "__cell", levels, slack, most_deg))
    sizes = near.groupBy("__cell").agg(F.count("*").alias("__n"))
    listed = near.join(sizes.where(F.col("__n") <= many).select("__cell"), "__cell", "left_semi").join(placed, ["__level", "__pixel"])
    listed = listed.select("__cell", F.struct(sep_degrees("__lra", "__ldec", "__ra", "__dec").alias("away"), "__ra", "__dec", "__key", *[c.alias(n) for n, c in zip("xyz", sky.unit_xyz("__ra", "__dec"), strict=True)]).alias("p")).groupBy("__cell").agg(F.collect_list("p").alias("__all"), F.min("p.away").alias("__least"))  # `many` leaves a cell
    short = listed.select("__cell", F.filter("__all", lambda p: p["away"] <= F.col("__least") + (2 * slack + 1e-9)).alias("__list"))
    # squared chords, which are cheap, leave the positions that can be the nearest; separations decide among them
    chord = lambda p: (p["x"] - F.col("__x")) * (p["x"] - F.col("__x")) + (p["y"] - F.col("__y")) * (p["y"] - F.col("__y")) + (p["z"] - F.col("__z")) * (p["z"] - F.col("__z"))
    met = rows.join(short, "__cell").withColumn("__c", F.transform("__list", chord)).withColumn("__m", F.array_min("__c"))
    close = F.filter("__list", lambda p, k: F.element_at("__c", k + 1) <= F.col("__m") + F.col("__m") * 1e-9 + 1e-14)
    one = F.array_min(F.transform(close, lambda p: F.struct(sep_arcsec("__lra", "__ldec", p["__ra"], p["__dec"]).alias("__sep"), p["__key"].alias("__key"), p["__ra"].alias("__ra"), p["__dec"].alias("__dec"))))
    found = met.select("__id", one.alias("__b"))
    wide = cut(sizes.where(F.col("__n") > many).select("__cell"))
    if not wide.isEmpty():
        alone = leaves_within_reach(rows.join(wide, "__cell", "left_semi").select("__id", "__lra", "__ldec"), "__id", levels, 0.0, most_deg).join(placed, ["__level", "__pixel"])
        found = found.unionByName(alone.select("__id", F.struct(sep_arcsec("__lra", "__ldec", "__ra", "__dec").alias("__sep"), "__key", "__ra", "__dec").alias("__b")))
    best = found.groupBy("__id").agg(F.min("__b").alias("__b")).select("__id", "__b.__key", "__b.__ra", "__b.__dec", "__b.__sep")
    return best if most_deg is None else best.where(F.col("__sep") <= most_deg * 3600.0)


def nearest(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_coords: tuple[str, str] = ("ra", "dec"), right_coords: tuple[str, str] = ("ra", "dec"), suffixes: tuple[str, str] = ("_1", "_2"), sep: str = "sep_arcsec", leaf: int = LEAF, many: int = MANY) -> DataFrame:
    """The nearest right row of every left row with a finite position, ties to the smaller right key; clashing names take the suffixes."""
    clash = set(left.columns) & set(right.columns)
    l_name = {c: c + suffixes[0] if c in clash else c for c in left.columns}
    r_name = {c: c + suffixes[1] if c in clash else c for c in right.columns}
    a, b = left.withColumnsRenamed(l_name), right.withColumnsRenamed(r_name)
    lc, rc = tuple(l_name[c] for c in left_coords), tuple(r_name[c] for c in right_coords)
    lk, rk = l_name[left_key], r_name[right_key]
    a = a.where(finite(*lc))
    ra, dec = sanitize(*lc)
    best = partners(a.select(F.col(lk).alias("__id"), ra.alias("__lra"), dec.alias("__ldec")), b, rk, rc, leaf, many).withColumnRenamed("__sep", sep)
    r_ra, r_dec = sanitize(*rc)
    whole = b.withColumns({"__key": F.col(rk), "__ra": r_ra, "__dec": r_dec}).dropDuplicates(["__key", "__ra", "__dec"])
    one = a.dropDuplicates([lk])
    others = [c for c in [*one.columns, *b.columns] if c != lk]
    return one.join(best, F.col(lk) == F.col("__id")).join(whole, ["__key", "__ra", "__dec"]).select(lk, *others, sep)
