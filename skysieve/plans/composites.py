"""What users run as one thing: late filters, position fix, sidecars, exports, comparisons, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions import sky
from skysieve.operators import dedup, filters, fit, flags, pixels, skyjoin, spikes
from skysieve.plans import stages


def late_filters(rows: DataFrame, stars: DataFrame | None, group: Sequence[str] = ("tile_id",), key: str = "src_id", rules=spikes.RULES) -> tuple[DataFrame, DataFrame]:
    """(survivors, rows with every reason): extract gate, shape, then bright stars, each reason from the filter itself."""
    reasons = filters.reject_reasons(rows, [*group])
    passed = reasons.where("reject_reason IS NULL").drop("reject_stage", "reject_reason")
    if stars is None:
        return passed, reasons
    judged = spikes.judged(spikes.near_bright(passed, stars, key), rules)
    return judged.where("NOT spike_reject").select(*rows.columns), reasons.join(judged.select(key, "spike_reject", "spike_reason"), key, "left")


def veto_then_filter(rows: DataFrame, catalogues: Sequence[tuple[str, DataFrame]], stars: DataFrame | None, radius: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(survivors, accounting): vetoes first, then the late filters."""
    carried, account = stages.cascade(rows, catalogues, radius)
    return late_filters(carried, stars)[0], account


def filter_then_match(rows: DataFrame, catalogues: Mapping[str, DataFrame], stars: DataFrame | None, radius: float = 5.0, raw_if_empty: bool = False) -> stages.StageResult:
    """The other order: late filters first; nothing left may fall back to the raw rows."""
    kept = late_filters(rows, stars)[0]
    if raw_if_empty and kept.isEmpty():
        kept = rows
    return stages.flag_stage(kept, catalogues, radius)


def fix_positions(rows: DataFrame, catalogue: DataFrame, centres: DataFrame, radius: float = 5.0, how: fit.FitConfig = fit.FitConfig(), second: fit.FitConfig | None = None, key: str = "src_id", other: str = "cat_id") -> DataFrame:
    """Corrected rows: best catalogue partner, a robust polynomial a tile; tiles with too few partners try `second`."""
    placed = rows.join(centres.select("tile_id", "ra0", "dec0"), "tile_id")
    best = skyjoin.match_best(rows.select(key, "ra", "dec"), catalogue.select(other, F.col("ra").alias("ra_ref"), F.col("dec").alias("dec_ref")), radius, key, other, right_coords=("ra_ref", "dec_ref"))
    ties = placed.join(best.select(key, "ra_ref", "dec_ref"), key)
    solved = fit.fits(ties, "tile_id", how)
    if second is not None:
        failed = solved.where("NOT ok").select("tile_id")
        again = fit.fits(ties.join(failed, "tile_id", "left_semi"), "tile_id", second)
        solved = solved.join(failed, "tile_id", "left_anti").unionByName(again)
    return fit.apply_fit(placed, solved, "tile_id", how.degree)


def infrared_sidecar(seeds: DataFrame, frames: DataFrame, radius: float = 5.0, key: str = "opt_source_id") -> DataFrame:
    """Nearest good frame of each seed within the radius; frames are made unique by cntr first."""
    good = dedup.first_by(filters.neowise_gate(frames), ["cntr"], [F.col("mjd")])
    right = good.withColumnsRenamed({"ra": "ra_f", "dec": "dec_f"})
    return skyjoin.match_best(seeds, right, radius, key, "cntr", right_coords=("ra_f", "dec_f"))


def infrared_by_pixel(seeds: DataFrame, frames: pixels.PixelCatalogue, radius: float = 5.0, key: str = "opt_source_id") -> DataFrame:
    """The same from frames that are stored by pixel, whose cntr is unique: the frames don't move, and the gates reach their scan."""
    return pixels.pixel_nearest(seeds, frames, radius, key, "cntr", gate=filters.neowise_gate)


def masked_view(master: DataFrame, sidecars: Mapping[str, tuple[DataFrame, str | Sequence[str]]], expression: str, tokens: Mapping[str, str], path: str | None = None, tol_arcsec: float = 0.5, keys: Sequence[str] = ("tile_id", "NUMBER")) -> DataFrame:
    """Survivors of a mask with all their columns: narrow keys first, then the wide rows by a semi-join, by bins."""
    narrow = dedup.grid_first(master.select(*keys, "ra", "dec"), tol_arcsec, [F.col(k) for k in keys])
    survivors = flags.masked_union(narrow, sidecars).where(flags.mask(expression, tokens)).select(*keys)
    wide = master.join(survivors, [*keys], "left_semi")
    if path:
        wide.write.mode("overwrite").option("compression", "zstd").partitionBy("ra_bin", "dec_bin").parquet(path)
    return wide


def compare_radii(rows: DataFrame, catalogue: DataFrame, radii: Sequence[float] = (2.0, 5.0), key: str = "src_id", other: str = "cat_id") -> DataFrame:
    """Rates of one nearest-neighbour search at several radii."""
    right = catalogue.withColumnsRenamed({"ra": "ra_c", "dec": "dec_c"})
    best = skyjoin.match_best(rows.select(key, "ra", "dec"), right, max(radii), key, other, right_coords=("ra_c", "dec_c"))
    return skyjoin.multi_radius(best, radii, rows.count())


def bounds_of(seeds: DataFrame, pad_arcsec: float) -> tuple[float, float, float, float] | None:
    """RA and Dec limits of a small probe side, padded, for literal filters that reach the other side's scan."""
    pad = pad_arcsec / 3600.0
    lo, hi, south, north = seeds.agg(F.min("ra"), F.max("ra"), F.min("dec"), F.max("dec")).first()
    if lo is None:
        return None
    if hi - lo > 180.0:
        return 0.0, 360.0, south - pad, north + pad
    import math

    widen = pad / max(1e-6, math.cos(math.radians(min(89.9, max(abs(south), abs(north)) + pad))))
    return (lo - widen) % 360.0, (hi + widen) % 360.0, south - pad, north + pad


def prune(frames: DataFrame, limits: tuple[float, float, float, float]) -> DataFrame:
    return frames.where(sky.in_box("ra", "dec", *limits))


def funnel_markdown(account: DataFrame) -> str:
    """A table of the accounting, one line a veto."""
    lines = ["| step | veto | before | after | eliminated | pairs |", "|---|---|---|---|---|---|"]
    for r in account.orderBy("step").collect():  # one row a veto
        lines.append(f"| {r['step']} | {r['veto']} | {r['n_before']} | {r['n_after']} | {r['n_eliminated']} | {r['n_pairs']} |")
    return "\n".join(lines) + "\n"


def science_match(science: DataFrame, optical: DataFrame, radius: float = 2.0, key: str = "row_id", other: str = "src_id") -> tuple[DataFrame, DataFrame]:
    """(one-to-one matches within the radius, science rows without one)."""
    right = optical.select(other, F.col("ra").alias("ra_o"), F.col("dec").alias("dec_o"))
    found = skyjoin.match_symmetric(science, right, radius, key, other, right_coords=("ra_o", "dec_o"))
    return found, science.join(found.select(key), key, "left_anti")


def buckets(rows: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One row of counts, a column a bucket."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])
