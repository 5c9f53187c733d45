"""Deduplication in space and by key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysieve.functions.sky import finite, grid_cell
from skysieve.operators.skyjoin import CELL, FACTOR, ZONE, pairs, zoned
from skysieve.session import cut

#: 64-bit keys that a list may have to be broadcast (about 64 bytes each once hashed).
FEW_KEYS = 4_000_000


def nan_last(x: Column | str) -> Column:
    """A sort key with NaN and null after every number."""
    return F.struct((~finite(x)).alias("none"), F.when(finite(x), x if isinstance(x, Column) else F.col(x)).alias("x"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key: the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def grid_best(df: DataFrame, tol_arcsec: float, tie: Sequence[Column], flags: str = "FLAGS", mag: str = "MAG_AUTO", group: Sequence[str] = ()) -> DataFrame:
    """Best row of each grid cell: fewest flags, then brightest, then `tie`; halves of a cell round to even."""
    tol = tol_arcsec / 3600.0
    celled = df.withColumn("__ra", grid_cell("ra", tol)).withColumn("__dec", grid_cell("dec", tol))
    order = [nan_last(F.col(c).cast("double")) for c in (flags, mag) if c in df.columns] + [*tie]
    return first_by(celled, [*group, "__ra", "__dec"], order).drop("__ra", "__dec")


def grid_first(df: DataFrame, tol_arcsec: float, order: Sequence[Column]) -> DataFrame:
    """First row of each grid cell; halves round away from zero."""
    tol = tol_arcsec / 3600.0
    celled = df.withColumn("__ra", grid_cell("ra", tol, "away")).withColumn("__dec", grid_cell("dec", tol, "away"))
    return first_by(celled, ["__ra", "__dec"], order).drop("__ra", "__dec")


def first_values(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row a key with the first non-null value of every column in order."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    others = [c for c in df.columns if c != key]
    filled = df.select(key, *[F.first(c, ignorenulls=True).over(whole).alias(c) for c in others], F.row_number().over(w).alias("__nth"))
    return filled.where("__nth = 1").drop("__nth").select(*df.columns)


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of a key, ties to the smaller value."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return first_by(counts, [key], [F.desc("n"), F.col(value)])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest reachable node, by contraction rounds between checkpoints."""
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("m", F.explode(F.array("u", "v")).alias("u")).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        new = cut(small)
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = new


def key_list(keys: DataFrame) -> DataFrame:
    """A list of distinct 64-bit keys, stored; up to FEW_KEYS are broadcast, so the rows looked up in it needn't move."""
    listed = cut(keys)
    return F.broadcast(listed) if listed.count() <= FEW_KEYS else listed


def crowded(df: DataFrame, tol_arcsec: float, group: Sequence[str] = ()) -> DataFrame:
    """The rows that share a cell with another row of their group: all that have one within the tolerance, and some that don't.

    A row is copied to the cells that half the tolerance reaches, so two partners meet in the cell of the point between
    them. Cells are counted by hash, and hashes that clash only let more rows in. A row comes once for each such cell.
    """
    celled = zoned(df, ("ra", "dec"), tol_arcsec / 2, True, 2 * FACTOR).withColumn("__met", F.xxhash64(ZONE, CELL, *group)).drop(ZONE, CELL)
    many = celled.groupBy("__met").agg(F.count("*").alias("n")).where("n > 1").select("__met")
    return celled.join(key_list(many), "__met", "left_semi").drop("__met")


def cluster_pairs(df: DataFrame, tol_arcsec: float, key: str, group: Sequence[str] = ()) -> DataFrame:
    """(a, b) of rows of one group within the tolerance: the zone join of the table with itself."""
    slim = df.select(key, "ra", "dec", *group)
    other = slim.withColumnsRenamed({c: f"{c}_o" for c in slim.columns})
    met = pairs(slim, other, tol_arcsec, right_coords=("ra_o", "dec_o")).where(F.col(key) < F.col(f"{key}_o"))
    for g in group:
        met = met.where(F.col(g).eqNullSafe(F.col(f"{g}_o")))
    return met.select(F.col(key).alias("a"), F.col(f"{key}_o").alias("b"))


def links(df: DataFrame, tol_arcsec: float, key: str, group: Sequence[str] = ()) -> DataFrame:
    """(key, cluster_id) of the rows that have any other within the tolerance: the smallest key of the transitive closure."""
    roots = components(cluster_pairs(df, tol_arcsec, key, group))
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())  # components leave out the root itself
    return every.select(F.col("node").alias(key), F.col("root").alias("cluster_id"))


def clusters(df: DataFrame, tol_arcsec: float, key: str, group: Sequence[str] = ()) -> DataFrame:
    """`df` with cluster_id, the smallest key of the transitive closure of pairs within the tolerance."""
    found = links(df, tol_arcsec, key, group).withColumnRenamed("cluster_id", "__root")
    return df.join(found, key, "left").withColumn("cluster_id", F.coalesce("__root", key)).drop("__root")


def representatives(clustered: DataFrame, key: str, core: Column | None = None) -> DataFrame:
    """(cluster_id, rep_id, n): a core member first, then the smallest key."""
    order = F.struct(F.when(core, 0).otherwise(1) if core is not None else F.lit(0), F.col(key))
    return clustered.groupBy("cluster_id").agg(F.min_by(key, order).alias("rep_id"), F.count("*").alias("n"))


def flags_of_members(clustered: DataFrame, key: str, flags: DataFrame, names: Sequence[str], core: Column | None = None) -> DataFrame:
    """(rep_id, flags): a representative has a flag if any member of its cluster has."""
    reps = representatives(clustered, key, core)
    joined = clustered.select(key, "cluster_id").join(flags, key, "left")
    return joined.groupBy("cluster_id").agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in names]).join(reps.select("cluster_id", "rep_id"), "cluster_id").select("rep_id", *names)


def plate_components(frame: pd.DataFrame, tol_arcsec: float) -> np.ndarray:
    """Roots (row numbers) of one small group's rows: a union-find over sorted declinations, for use in applyInPandas."""
    order = np.argsort(frame["dec"].to_numpy(float), kind="stable")
    dec, ra = frame["dec"].to_numpy(float)[order], frame["ra"].to_numpy(float)[order]
    parent = np.arange(len(frame))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tol = tol_arcsec / 3600.0
    for i in range(len(order)):
        j = i + 1
        while j < len(order) and dec[j] - dec[i] <= tol:
            u, v = np.sin(np.radians(dec[j] - dec[i]) / 2), np.sin(np.radians(ra[j] - ra[i]) / 2)
            s = 2 * np.degrees(np.arcsin(min(1.0, np.sqrt(u * u + np.cos(np.radians(dec[i])) * np.cos(np.radians(dec[j])) * v * v))))
            if s <= tol:
                a, b = find(order[i]), find(order[j])
                parent[max(a, b)] = min(a, b)
            j += 1
    return np.array([find(i) for i in range(len(frame))])
