"""Quality gates, robust clips and reason codes over detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions.sky import col, finite
from skysieve.functions.text import in_arcsec, moon_code, valid_magnitude

#: Gates of the funnel.
SNR, CLIP_K, SPREAD, FWHM, ELONGATION, EXTENT_DELTA, EXTENT_LEAST = 30.0, 2.0, -0.002, (2.0, 7.0), 1.3, 2.0, 1.0
MAD_SIGMA = 1.4826


def has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def every(*conditions: Column) -> Column:
    """All conditions, where null is false; no condition is true."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(True))


def extract_gate(df: DataFrame, flags: str = "FLAGS", snr: str = "SNR_WIN", least_snr: float = SNR) -> DataFrame:
    """FLAGS = 0 and SNR above the limit; a column that is absent gates nothing."""
    tests = ([col(flags) == 0] if has(df, flags) else []) + ([finite(snr) & (col(snr) > least_snr)] if has(df, snr) else [])
    return df.where(every(*tests))


def clip_bounds(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """Median and sigma (MAD-based, NaN ignored) of columns by group, in two aggregates; suffixes _med and _sigma."""
    safe = {c: F.when(finite(c), F.col(c)) for c in columns}
    med = df.groupBy(*group).agg(*[F.median(x).alias(f"{c}_med") for c, x in safe.items()])
    joined = df.select(*group, *columns).join(med, group) if group else df.select(*columns).crossJoin(F.broadcast(med))
    mad = joined.groupBy(*group).agg(*[F.first(f"{c}_med").alias(f"{c}_med") for c in columns], *[(F.median(F.abs(x - F.col(f"{c}_med"))) * MAD_SIGMA).alias(f"{c}_sigma") for c, x in safe.items()])
    return mad


def with_bounds(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    bounds = clip_bounds(df, columns, group)
    return df.join(bounds, group, "left") if group else df.crossJoin(F.broadcast(bounds))


def within_clip(c: str, k: float = CLIP_K) -> Column:
    """|x - median| <= k sigma; where sigma isn't positive every finite value stays."""
    wide = F.coalesce(~(F.col(f"{c}_sigma") > 0), F.lit(True))
    return finite(c) & (wide | (F.abs(F.col(c) - F.col(f"{c}_med")) <= k * F.col(f"{c}_sigma")))


def robust_clip(df: DataFrame, columns: list[str], group: list[str], k: float = CLIP_K) -> DataFrame:
    """Rows inside the clip of every column; all bounds come from the same input rows."""
    return with_bounds(df, columns, group).where(every(*[within_clip(c, k) for c in columns])).select(*df.columns)


def extents(df: DataFrame) -> tuple[Column, Column] | None:
    names = ("XMAX_IMAGE", "XMIN_IMAGE", "YMAX_IMAGE", "YMIN_IMAGE")
    return (F.col(names[0]) - F.col(names[1]), F.col(names[2]) - F.col(names[3])) if has(df, *names) else None


def morphology_rules(df: DataFrame, clip: bool = True, k: float = CLIP_K) -> dict[str, Column]:
    """Reason -> condition to pass, in order; rules of absent columns are left out. Clips need with_bounds first."""
    rules: dict[str, Column] = {}
    for name, reason in (("FWHM_IMAGE", "sigma_clip_fwhm"), ("ELONGATION", "sigma_clip_elongation")):
        if clip and has(df, name):
            rules[reason] = within_clip(name, k)
    if has(df, "SPREAD_MODEL"):
        rules["spread_model"] = finite("SPREAD_MODEL") & (F.col("SPREAD_MODEL") > SPREAD)
    if has(df, "FWHM_IMAGE"):
        rules["fwhm"] = finite("FWHM_IMAGE") & (F.col("FWHM_IMAGE") > FWHM[0]) & (F.col("FWHM_IMAGE") < FWHM[1])
    if has(df, "ELONGATION"):
        rules["elongation"] = finite("ELONGATION") & (F.col("ELONGATION") < ELONGATION)
    if (d := extents(df)) is not None:
        rules["extent_min"] = finite(*d) & (d[0] > EXTENT_LEAST) & (d[1] > EXTENT_LEAST)
        rules["extent_delta"] = finite(*d) & (F.abs(d[0] - d[1]) < EXTENT_DELTA)
    return rules


def morphology(df: DataFrame, group: list[str], clip: bool = True, k: float = CLIP_K) -> DataFrame:
    """Rows that pass every shape rule; clip statistics by group over the rows that come in."""
    columns = [c for c in ("FWHM_IMAGE", "ELONGATION") if has(df, c)]
    bounded = with_bounds(df, columns, group) if clip and columns else df
    return bounded.where(every(*morphology_rules(df, clip, k).values())).select(*df.columns)


def xy_bounds(df: DataFrame, x: tuple[float | None, float | None] = (None, None), y: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Inclusive pixel bounds; an open end or absent column bounds nothing."""
    tests = [F.col(c) >= lo if k == 0 else F.col(c) <= lo for c, b in (("X_IMAGE", x), ("Y_IMAGE", y)) if has(df, c) for k, lo in enumerate(b) if lo is not None]
    return df.where(every(*tests))


def reject_reasons(df: DataFrame, group: list[str], k: float = CLIP_K) -> DataFrame:
    """`df` with reject_stage (extract, morphology or null) and reject_reason, several joined by a pipe.

    Clip statistics come from the rows that pass the extract gate, so the reasons agree with the filters.
    """
    first = {}
    if has(df, "FLAGS"):
        first["flags"] = F.coalesce(F.col("FLAGS") == 0, F.lit(False))
    if has(df, "SNR_WIN"):
        first["snr"] = finite("SNR_WIN") & (F.col("SNR_WIN") > SNR)
    columns = [c for c in ("FWHM_IMAGE", "ELONGATION") if has(df, c)]
    bounds = clip_bounds(df.where(every(*first.values())), columns, group)
    joined = df.join(bounds, group, "left") if group else df.crossJoin(F.broadcast(bounds))
    listed = lambda rules: F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]).cast("array<string>"))
    extract, shape = listed(first), listed(morphology_rules(df, True, k))
    stage = F.when(F.size(extract) > 0, "extract").when(F.size(shape) > 0, "morphology")
    reason = F.when(F.size(extract) > 0, F.array_join(extract, "|")).when(F.size(shape) > 0, F.array_join(shape, "|"))
    return joined.select(*df.columns, stage.alias("reject_stage"), reason.alias("reject_reason"))


def reason_tallies(reasons: DataFrame) -> DataFrame:
    """(reason, n): rows a reason rejects, and `kept`."""
    each = reasons.select(F.explode(F.split(F.coalesce("reject_reason", F.lit("kept")), r"\|")).alias("reason"))
    return each.groupBy("reason").agg(F.count("*").alias("n"))


def within_arcsec(df: DataFrame, separation: str, limit: float = 5.0, unit: str = "arcsec") -> DataFrame:
    """Rows whose separation is finite and at most the limit; unit arcsec, deg or guess (per row)."""
    return df.where(every(finite(separation), in_arcsec(separation, unit) <= limit))


def within_arcsec_by_table(df: DataFrame, separation: str, limit: float = 5.0) -> DataFrame:
    """The unit is one for the table: arcseconds if any row is within the limit so read, else degrees."""
    near = df.where(every(finite(separation), F.col(separation) <= limit))
    return near if not near.isEmpty() else df.where(every(finite(separation), F.col(separation) * 3600.0 <= limit))


def southern_cut(df: DataFrame, dec: str = "dec", least: float = 0.0) -> DataFrame:
    """Rows at or north of a declination; rows without one stay."""
    return df.where(~F.coalesce(finite(dec) & (F.col(dec) < least), F.lit(False)))


def ps1_covered(dec: Column | str, radius_deg: float = 0.0, limit: float = -30.0) -> Column:
    """False where a tile, with its whole cone, lies south of the survey's limit."""
    return col(dec) + radius_deg >= limit


def neowise_gate(df: DataFrame, latest_mjd: float = 59198.0) -> DataFrame:
    """Frame quality, scatter, anomaly distance, signal and date; moon flags as text, after the numeric gates."""
    n = every(F.col("qual_frame") > 0, finite("qi_fact") & (F.col("qi_fact") > 0), finite("saa_sep") & (F.col("saa_sep") > 0), finite("w1snr") & (F.col("w1snr") >= 5), finite("mjd") & (F.col("mjd") <= latest_mjd))
    return df.where(n & F.coalesce(moon_code("moon_masked") == "00", F.lit(False)))


def bright_stars(df: DataFrame, mag: str = "rmag", detections: str = "nDetections", faintest: float = 16.0, least: int = 2) -> DataFrame:
    """Finite positions, a valid magnitude up to the limit, enough detections where counted."""
    tests = [finite("ra", "dec"), valid_magnitude(mag, faintest=faintest)] + ([F.col(detections) >= least] if has(df, detections) else [])
    return df.where(every(*tests))


def fit_quality(df: DataFrame) -> DataFrame:
    """Rows good enough to fit a plate: unflagged, round, not saturated; by the columns that exist."""
    tests = {"FLAGS": F.col("FLAGS") == 0, "ELONGATION": F.col("ELONGATION") <= 1.7, "MAG_AUTO": F.col("MAG_AUTO") > -13} if df.columns else {}
    return df.where(every(*[t for c, t in tests.items() if has(df, c)]))


def any_flag(df: DataFrame, suffix: str = "_match", prefix: str = "has_") -> Column:
    """True where any has_*_match column is; none: false."""
    names = [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in names], F.lit(False))


def strict_match(df: DataFrame, radius: float) -> Column:
    """A strict match by the first column there is: has_ir_match, ir_match_strict, sep_arcsec, dist_arcsec."""
    for c in ("has_ir_match", "ir_match_strict"):
        if has(df, c):
            from skysieve.functions.text import truthy

            return truthy(c)
    for c in ("sep_arcsec", "dist_arcsec"):
        if has(df, c):
            return every(finite(c), F.col(c) <= radius)
    return F.lit(False)


def close(a: Column | str, b: Column | str, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """|a - b| <= max(absolute, relative * max(|a|, |b|)); two nulls agree."""
    a, b = col(a), col(b)
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b))), a.isNull() & b.isNull())
