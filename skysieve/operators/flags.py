"""Flag tables: collapse, union, masks, remainders, comparison of two match sets."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions.sky import finite
from skysieve.functions.text import truthy
from skysieve.operators.filters import close

#: Flags that take a row out of the remainder.
GATES = ("has_vosa_like_match", "is_supercosmos_artifact", "ptf_match_ngood", "is_known_variable_or_transient", "skybot_strict")


def collapse(rows: DataFrame, key: str, flag: str = "has_ir_match", distance: str = "dist_arcsec") -> DataFrame:
    """One row a key: any flag, least finite distance. Keys that repeat over files are merged too."""
    return rows.groupBy(key).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag), F.min(F.when(finite(distance), F.col(distance))).alias(distance))


def full_sidecar(seed: DataFrame, collapsed: DataFrame, key: str, flag: str = "has_ir_match") -> DataFrame:
    """A row for every key of the seed; absent: no match."""
    return seed.select(key).distinct().join(collapsed, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def masked_union(base: DataFrame, sidecars: Mapping[str, tuple[DataFrame, str | Sequence[str]]]) -> DataFrame:
    """`base` with one boolean for each flag name, from (table of flag and key, key). Keys are made distinct first, so
    rows never multiply; a missing flag is false."""
    by_key: dict = {}
    for name, (rows, key) in sidecars.items():
        keys = [key] if isinstance(key, str) else [*key]
        by_key.setdefault((*keys, *[str(rows.schema[k].dataType) for k in keys]), (keys, []))[1].append((name, rows))
    out = base
    for keys, tables in by_key.values():  # tables of one key are one join, so `base` moves once for each key
        every = None
        for name, rows in tables:
            one = rows.select(*keys, *[(truthy(name) if n == name else F.lit(None).cast("boolean")).alias(n) for n, _ in tables])
            every = one if every is None else every.unionByName(one)
        names = [n for n, _ in tables]
        found = every.groupBy(*keys).agg(*[F.bool_or(n).alias(n) for n in names])
        out = out.join(found, keys, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in names})
    return out.select(*base.columns, *sidecars)


def flag_index(tables: Mapping[str, DataFrame], tile: str = "tile_id", number: str = "NUMBER") -> DataFrame:
    """(tile, bucket, gates): bitmaps of the numbers that each flag table names, by tile, 32,768 numbers a bucket.

    A table without a tile column holds for all tiles; its rows have a null tile. Rows without a number, or without the tile that
    their table has, name nothing. Bitmaps are built before the shuffle and merged after it, whatever the tables repeat.
    """
    parts = None
    for name, rows in tables.items():
        where = F.col(tile).cast("string") if tile in rows.columns else F.lit(None).cast("string")
        n = F.col(number).cast("long")
        good = rows.where(n.isNotNull() & where.isNotNull()) if tile in rows.columns else rows.where(n.isNotNull())
        one = good.select(F.lit(name).alias("gate"), where.alias(tile), F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("place"))
        parts = one if parts is None else parts.unionByName(one)
    bits = parts.groupBy("gate", tile, "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    return bits.groupBy(tile, "bucket").agg(F.map_from_entries(F.collect_list(F.struct("gate", "bits"))).alias("gates"))  # one entry a gate


def indexed_flags(rows: DataFrame, index: DataFrame, gates: Sequence[str], tile: str = "tile_id", number: str = "NUMBER") -> DataFrame:
    """`rows` with a boolean for each gate, read from the bitmaps of the row's tile or of all tiles; no number: false."""
    n = F.col(number).cast("long")
    keyed = rows.withColumns({"__bucket": F.bitmap_bucket_number(n), "__place": F.bitmap_bit_position(n), "__tile": F.col(tile).cast("string")})
    mine = index.where(F.col(tile).isNotNull()).select(F.col(tile).alias("__tile"), F.col("bucket").alias("__bucket"), F.col("gates").alias("__mine"))
    all_ = index.where(F.col(tile).isNull()).select(F.col("bucket").alias("__bucket"), F.col("gates").alias("__all"))
    met = keyed.join(mine, ["__tile", "__bucket"], "left").join(all_, "__bucket", "left")

    def holds(bitmap: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bitmap, (F.col("__place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.bit_get(byte, F.pmod(F.col("__place"), F.lit(8)).cast("int")) == 1, F.lit(False))

    return met.select(*rows.columns, *[(holds(F.col("__mine")[g]) | holds(F.col("__all")[g])).alias(g) for g in gates])


def indexed_survivors(rows: DataFrame, index: DataFrame, gates: Sequence[str], tile: str = "tile_id", number: str = "NUMBER") -> tuple[DataFrame, DataFrame]:
    """(rows that no gate names, tallies: rows, rows of each gate, kept)."""
    flagged = indexed_flags(rows, index, gates, tile, number)
    clear = F.lit(True)
    for g in gates:
        clear = clear & ~F.col(g)
    tallies = flagged.agg(F.count("*").alias("n_rows"), *[F.count_if(g).alias(f"n_{g}") for g in gates], F.count_if(clear).alias("n_kept"))
    return flagged.where(clear).select(*rows.columns), tallies


def passes(gates: Sequence[str], columns: Sequence[str]) -> Column:
    """True where no gate is set; absent columns and nulls pass."""
    out = F.lit(True)
    for g in gates:
        if g in columns:
            out = out & ~truthy(g)
    return out


def remainder(rows: DataFrame, gates: Sequence[str] = GATES) -> DataFrame:
    return rows.where(passes(gates, rows.columns))


def core_only(rows: DataFrame, edge_report: DataFrame) -> DataFrame:
    """Rows of tiles that are core by pixels or arcseconds."""
    from skysieve.functions.sky import is_core

    core = edge_report.where(is_core("class_px", "class_arcsec")).select("tile_id").distinct()
    return rows.join(core, "tile_id", "left_semi")


def gate_tallies(rows: DataFrame, gates: Sequence[str] = GATES) -> DataFrame:
    """One row: rows, rows of each gate, and the remainder with and without the last gate."""
    return rows.agg(
        F.count("*").alias("masked_rows"),
        *[F.count_if(truthy(g)).alias(f"{g}_rows") for g in gates],
        F.count_if(passes(gates[:-1], rows.columns)).alias("remainder_without_last"),
        F.count_if(passes(gates, rows.columns)).alias("remainder_with_all"),
    )


class MaskError(ValueError):
    """A mask expression with a token that isn't allowed."""


def mask(expression: str, flags: Mapping[str, str]) -> Column:
    """Column of a mask such as `exclude_hpm and (exclude_edge or not exclude_spike)`.

    exclude_x means: the flag column of x isn't set. Only names in `flags`, and, or, not and brackets are accepted.
    """
    tokens = re.findall(r"[A-Za-z_][A-Za-z_0-9]*|[()]|\S", expression)
    at = 0

    def peek() -> str | None:
        return tokens[at].lower() if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def either() -> Column:
        out = both()
        while peek() == "or":
            take()
            out = out | both()
        return out

    def both() -> Column:
        out = single()
        while peek() == "and":
            take()
            out = out & single()
        return out

    def single() -> Column:
        if peek() is None:
            raise MaskError("the mask ends early")
        token = take()
        if token.lower() == "not":
            return ~single()
        if token == "(":
            out = either()
            if peek() != ")":
                raise MaskError("a bracket isn't closed")
            take()
            return out
        if token.startswith("exclude_") and token.removeprefix("exclude_") in flags:
            return ~truthy(flags[token.removeprefix("exclude_")])
        raise MaskError(f"{token!r} isn't allowed in a mask")

    out = either()
    if at < len(tokens):
        raise MaskError(f"{tokens[at]!r} is left over")
    return out


def compare(left: DataFrame, right: DataFrame, key: Sequence[str], tolerances: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Full outer comparison: key, side (both, left_only, right_only) and agree over the columns' tolerances."""
    a = left.select(*key, *[F.col(c).alias(f"{c}_l") for c in tolerances], F.lit(True).alias("__l"))
    b = right.select(*key, *[F.col(c).alias(f"{c}_r") for c in tolerances], F.lit(True).alias("__r"))
    met = a.join(b, [*key], "full_outer")
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    agree = F.lit(True)
    for c, (absolute, relative) in tolerances.items():
        agree = agree & close(f"{c}_l", f"{c}_r", absolute, relative)
    return met.select(*key, side.alias("side"), F.when(side == "both", agree).alias("agree"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count_if(F.col("side") == "both").alias("overlap"), F.count_if(F.col("agree")).alias("n_match"), F.count_if(~F.col("agree")).alias("n_mismatch"), F.count_if(F.col("side") == "right_only").alias("missing_left"), F.count_if(F.col("side") == "left_only").alias("missing_right"))


def explain_missing(missing: DataFrame, box: Column, gates: Mapping[str, Column]) -> DataFrame:
    """`missing` with why: outside the box, the first gate that fails, or unexplained."""
    why = F.when(~F.coalesce(box, F.lit(False)), "outside_box")
    for name, gate in gates.items():
        why = why.when(~F.coalesce(gate, F.lit(False)), name)
    return missing.withColumn("why", why.otherwise("unexplained"))


def ids_union(*lists: DataFrame, distinct: bool = False) -> DataFrame:
    """All ids of the lists' only column NUMBER."""
    out = lists[0].select("NUMBER")
    for x in lists[1:]:
        out = out.unionByName(x.select("NUMBER"))
    return out.distinct() if distinct else out


def unmatched(rows: DataFrame, matched: DataFrame, key: str = "NUMBER") -> DataFrame:
    """Rows whose key isn't matched; no matched key keeps all rows."""
    return rows.join(matched.select(key).distinct(), key, "left_anti")


def id_deltas(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): ids only in the old or only in the new set."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return a.exceptAll(b).withColumn("change", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))
