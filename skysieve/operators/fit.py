"""Position correction by a clipped polynomial of offsets, one fit a tile, from sums that add up.

A fit needs the moments of its rows only (products of features, and of features with offsets), which are plain sums with
map-side combine; what is solved for a tile is one small matrix, however many rows it has. Clip rounds are joins with
the solutions, and their medians are selected by rank (operators.quantiles), so no tile's rows are ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from skysieve.functions.sky import finite, poly_features, poly_value, wrap180, wrap360
from skysieve.operators import quantiles
from skysieve.session import cut


@dataclass(frozen=True)
class FitConfig:
    degree: int = 2
    rounds: int = 3
    least_matches: int = 20
    clip_least: float = 1.5
    clip_sigmas: float = 3.0
    clip_most: float = 10.0


def terms(degree: int) -> int:
    return 6 if degree > 1 else 3


def offsets(matches: DataFrame, group: str, centre: tuple[str, str] = ("ra0", "dec0"), detected: tuple[str, str] = ("ra", "dec"), true: tuple[str, str] = ("ra_ref", "dec_ref"), more: Sequence[str] = ()) -> DataFrame:
    """(group, x, y, ox, oy): place in the tile and offset to the true position, in degrees."""
    x, y = wrap180(F.col(detected[0]) - F.col(centre[0])), F.col(detected[1]) - F.col(centre[1])
    return matches.select(group, x.alias("x"), y.alias("y"), wrap180(F.col(true[0]) - F.col(detected[0])).alias("ox"), (F.col(true[1]) - F.col(detected[1])).alias("oy"), *more)


def _solve(gram: Sequence[float], ra: Sequence[float], dec: Sequence[float]) -> tuple[list[float], list[float]]:
    """Least squares by the normal equations, scaled to a unit diagonal; the smallest solution where features depend on each other."""
    p = len(ra)
    g, rhs = np.zeros((p, p)), np.column_stack([ra, dec]).astype(float)
    g[np.triu_indices(p)] = gram
    g = g + np.triu(g, 1).T
    scale = 1.0 / np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    found = np.linalg.lstsq(g * scale[:, None] * scale[None, :], rhs * scale[:, None], rcond=1e-12)[0] * scale[:, None]
    return found[:, 0].tolist(), found[:, 1].tolist()


_COEFFICIENTS = StructType([StructField(c, ArrayType(DoubleType())) for c in ("coef_ra", "coef_dec")])


@F.pandas_udf(_COEFFICIENTS)
def solved(gram: pd.Series, ra: pd.Series, dec: pd.Series) -> pd.DataFrame:
    """Coefficients from the moments of one tile a row."""
    return pd.DataFrame([_solve(g, a, d) for g, a, d in zip(gram, ra, dec, strict=True)], columns=["coef_ra", "coef_dec"])


def moments(rows: DataFrame, group: Sequence[str], degree: int) -> DataFrame:
    """(group, n, gram, rhs_ra, rhs_dec): the sums that a fit of (x, y, ox, oy) needs, the upper triangle of its matrix row by row."""
    f = poly_features("x", "y", degree)
    gram = [F.sum(f[i] * f[j]).alias(f"g{i}_{j}") for i in range(len(f)) for j in range(i, len(f))]
    rhs = [F.sum(a * F.col(o)).alias(f"{o}{i}") for o in ("ox", "oy") for i, a in enumerate(f)]
    sums = rows.groupBy(*group).agg(F.count("*").alias("n"), *gram, *rhs)
    pick = lambda o: F.array(*[F.col(f"{o}{i}") for i in range(len(f))])
    return sums.select(*group, "n", F.array(*[F.col(f"g{i}_{j}") for i in range(len(f)) for j in range(i, len(f))]).alias("gram"), pick("ox").alias("rhs_ra"), pick("oy").alias("rhs_dec"))


def least_squares(rows: DataFrame, group: Sequence[str], degree: int) -> DataFrame:
    """(group, n, coef_ra, coef_dec) of plain fits."""
    found = moments(rows, group, degree).withColumn("__s", solved("gram", "rhs_ra", "rhs_dec"))
    return found.select(*group, "n", "__s.coef_ra", "__s.coef_dec")


def residual(degree: int) -> Column:
    """Distance in arcseconds between a row's offset and the polynomials in coef_ra and coef_dec."""
    dx, dy = F.col("ox") - poly_value("x", "y", F.col("coef_ra"), degree), F.col("oy") - poly_value("x", "y", F.col("coef_dec"), degree)
    return F.sqrt(dx * dx + dy * dy) * 3600.0


def fits(matches: DataFrame, group: str = "tile_id", how: FitConfig = FitConfig(), centre: tuple[str, str] = ("ra0", "dec0"), detected: tuple[str, str] = ("ra", "dec"), true: tuple[str, str] = ("ra_ref", "dec_ref")) -> DataFrame:
    """(group, ok, coef_ra, coef_dec, rounds, kept, dropped): one robust fit for each tile's matched rows.

    A round fits what is kept and drops rows beyond the clip threshold; a tile whose rows stay has its last fit, so
    further rounds leave it as it is. A tile that has too few rows in any round has no fit.
    """
    rows = cut(offsets(matches, group, centre, detected, true).withColumn("use", finite("x", "y", "ox", "oy")))
    sizes = cut(rows.groupBy(group).agg(F.count("*").alias("all")))
    history = None
    for turn in range(how.rounds + 1):
        found = cut(least_squares(rows.where("use"), [group], how.degree).where(F.col("n") >= how.least_matches))
        if turn == how.rounds:
            break
        judged = cut(rows.join(found, group, "left").withColumn("res", residual(how.degree)))
        middle = quantiles.exact(judged.select(group, "res"), "res", (0.5,), [group]).select(F.col(group).alias("__g"), F.col("p50").alias("mid"))
        away = judged.join(middle, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g").withColumn("dev", F.abs(F.col("res") - F.col("mid")))
        away = cut(away)
        spread = quantiles.exact(away.select(group, "dev"), "dev", (0.5,), [group]).select(F.col(group).alias("__g"), F.col("p50").alias("mad"))
        known = away.groupBy(group).agg(F.stddev_pop(F.when(finite("res"), F.col("res"))).alias("std"), F.count_if(finite("res")).alias("m")).join(spread, F.col(group).eqNullSafe(F.col("__g")), "left").drop("__g")
        sigma = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("m") > 10, F.col("std")).otherwise(F.lit(0.0))
        limit = F.least(F.when(sigma > 0, F.greatest(F.lit(how.clip_least), how.clip_sigmas * sigma)).otherwise(F.lit(how.clip_most)), F.lit(how.clip_most))
        limits = known.select(F.col(group).alias("__g"), limit.alias("limit"))
        kept = away.join(limits, F.col(group).eqNullSafe(F.col("__g")), "left").withColumn("keep", F.col("use") & F.coalesce(F.col("res") <= F.col("limit"), F.lit(False)))
        rows = cut(kept.select(group, "x", "y", "ox", "oy", F.col("use").alias("before"), F.col("keep").alias("use")))
        step = cut(rows.groupBy(group).agg(F.lit(turn + 1).alias("turn"), F.count_if("before").alias("n_before"), F.count_if("use").alias("n_after")))
        history = step if history is None else history.unionByName(step)
        rows = rows.drop("before")
        if step.where("n_before <> n_after").isEmpty():
            break
    out = sizes.join(found, [group], "left").withColumn("ok", F.col("n").isNotNull())
    if history is None:
        out = out.withColumn("rounds", F.lit(0))
    else:
        stable = F.coalesce(F.min(F.when(F.col("n_before") == F.col("n_after"), F.col("turn"))), F.max("turn"))
        out = out.join(history.groupBy(group).agg(stable.alias("rounds")), group, "left")
    kept_n = F.when(F.col("ok"), F.col("n")).otherwise(F.lit(0)).cast("long")
    return out.select(group, "ok", "coef_ra", "coef_dec", F.when(F.col("ok"), F.col("rounds")).otherwise(F.lit(0)).cast("int").alias("rounds"), kept_n.alias("kept"), (F.col("all") - kept_n).alias("dropped"))


def apply_fit(rows: DataFrame, solutions: DataFrame, group: str = "tile_id", degree: int = 2, centre: tuple[str, str] = ("ra0", "dec0"), detected: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """`rows` with RA_corr and Dec_corr; null where the position isn't finite or the tile has no solution."""
    joined = rows.join(solutions.where("ok").select(group, "coef_ra", "coef_dec"), group, "left")
    x, y = wrap180(F.col(detected[0]) - F.col(centre[0])), F.col(detected[1]) - F.col(centre[1])
    good = finite(*detected) & F.col("coef_ra").isNotNull()
    ra = F.when(good, wrap360(F.col(detected[0]) + poly_value(x, y, F.col("coef_ra"), degree)))
    dec = F.when(good, F.col(detected[1]) + poly_value(x, y, F.col("coef_dec"), degree))
    return joined.withColumn("RA_corr", ra).withColumn("Dec_corr", dec).drop("coef_ra", "coef_dec")


def consensus(matches: DataFrame, group: str, id_col: str, degree: int = 2, draws: int = 48, tolerance_arcsec: float = 1.0, seed: int = 0, centre: tuple[str, str] = ("ra0", "dec0"), detected: tuple[str, str] = ("ra", "dec"), true: tuple[str, str] = ("ra_ref", "dec_ref")) -> DataFrame:
    """(group, draw, agree, n, coef_ra, coef_dec): the fit of the rows that agree with the best of `draws` minimal fits.

    Draws are by hash of id and draw number, so they are the same whatever the partitions. Each draw takes, from the
    POOL rows of a tile with the smallest hashes, as many as the polynomial has terms, and is solved exactly; one aggregate over
    all rows and draws counts the rows within the tolerance; most rows win, ties to the smaller draw. A tile with fewer rows than terms has no fit.
    """
    p, pool = terms(degree), draws * terms(degree)
    rows = cut(offsets(matches, group, centre, detected, true, [id_col]).where(finite("x", "y", "ox", "oy")))
    order = [F.col("__h"), F.col(id_col), F.col("x"), F.col("y"), F.col("ox"), F.col("oy")]
    some = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_col))).withColumn("__nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__nth") <= pool)  # at most `pool` rows a tile leave a task
    drawn = some.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("__h", F.xxhash64(F.lit(seed), F.col("draw"), F.col(id_col)))
    sets = drawn.withColumn("__nth", F.row_number().over(Window.partitionBy(group, "draw").orderBy(*order))).where(F.col("__nth") <= p)
    models = cut(least_squares(sets, [group, "draw"], degree).where(F.col("n") == p).select(group, "draw", "coef_ra", "coef_dec"))
    by_tile = models.groupBy(group).agg(F.collect_list(F.struct("draw", "coef_ra", "coef_dec")).alias("models"))  # `draws` models a tile
    judged = rows.join(by_tile, group).withColumn("m", F.explode("models")).select(group, "x", "y", "ox", "oy", "m.draw", "m.coef_ra", "m.coef_dec")
    agree = judged.where(residual(degree) <= tolerance_arcsec).groupBy(group, "draw").agg(F.count("*").alias("agree"))
    best = cut(agree.groupBy(group).agg(F.max_by(F.struct("draw", "agree"), F.struct("agree", -F.col("draw"))).alias("b")).select(group, "b.draw", "b.agree"))
    chosen = models.join(best, [group, "draw"])
    inside = rows.join(chosen, group).where(residual(degree) <= tolerance_arcsec)
    return best.join(least_squares(inside.select(group, "x", "y", "ox", "oy"), [group], degree), group)
