"""Rejection near bright stars: rule objects compiled to Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions.text import valid_magnitude
from skysieve.operators.skyjoin import match_best


@dataclass(frozen=True)
class ConstRule:
    """Rejects at magnitude `brightest_kept` and brighter, whatever the distance."""

    limit: float = 12.4

    def hits(self, m: Column, d: Column) -> Column:
        return m <= self.limit

    def says(self, m: Column, d: Column) -> Column:
        return F.format_string(f"CONST(m*=%.2f <= {self.limit:.2f})", m)


@dataclass(frozen=True)
class LineRule:
    """Rejects where the magnitude is below slope * arcseconds + offset."""

    slope: float = -0.09
    offset: float = 15.3

    def hits(self, m: Column, d: Column) -> Column:
        # six decimals: a star on the line, up to the last bits of its distance, stays
        return m < F.round(self.slope * d + self.offset, 6)

    def says(self, m: Column, d: Column) -> Column:
        return F.format_string(f"LINE(m*=%.2f < {self.slope:.3f}*%.1f+{self.offset:.2f}=%.2f)", m, d, self.slope * d + self.offset)


RULES = (ConstRule(), LineRule())


def rules_from(config: Sequence[dict]) -> tuple[ConstRule | LineRule, ...]:
    """Rules of a parsed configuration: entries with const_max_mag, or with a and b."""
    return tuple(ConstRule(float(c["const_max_mag"])) if "const_max_mag" in c else LineRule(float(c["a"]), float(c["b"])) for c in config)


def near_bright(detections: DataFrame, stars: DataFrame, key: str, search_arcmin: float = 1.5, star_key: str = "star_id", coords: tuple[str, str] = ("ra", "dec")) -> DataFrame:
    """`detections` with bright_sep_arcsec and bright_mag of the nearest star within the search radius (null: none)."""
    slim = stars.select(F.col(star_key).alias("__star"), F.col("ra").alias("__ra"), F.col("dec").alias("__dec"), F.col("rmag").alias("bright_mag"))
    best = match_best(detections.select(key, *coords), slim, search_arcmin * 60.0, key, "__star", left_coords=coords, right_coords=("__ra", "__dec"))
    return detections.join(best.select(key, F.col("sep_arcsec").alias("bright_sep_arcsec"), "bright_mag"), key, "left")


def judged(df: DataFrame, rules: Sequence[ConstRule | LineRule] = RULES, faintest: float = 16.0) -> DataFrame:
    """`df` of near_bright with spike_reject and spike_reason; only a valid magnitude can reject."""
    m, d = F.col("bright_mag"), F.col("bright_sep_arcsec")
    usable = valid_magnitude(m, faintest=faintest) & d.isNotNull()
    hits = [F.coalesce(usable & r.hits(m, d), F.lit(False)) for r in rules]
    reject = F.lit(False)
    for h in hits:
        reject = reject | h
    reason = F.array_join(F.array_compact(F.array(*[F.when(h, r.says(m, d)) for h, r in zip(hits, rules, strict=True)]).cast("array<string>")), ";")
    return df.withColumn("spike_reject", reject).withColumn("spike_reason", reason)


def read_rules(spark: SparkSession, path: str) -> tuple[ConstRule | LineRule, ...]:
    """Rules of a YAML file: a list, or a mapping with the list under `rules`."""
    import yaml

    from skysieve.sources.tables import read_text

    found = yaml.safe_load(read_text(spark, path)) or []
    return rules_from(found.get("rules", []) if isinstance(found, dict) else found)


#: Magnitude columns of bright-star tables, the preferred first.
MAGNITUDES = ("phot_rp_mean_mag", "phot_g_mean_mag", "phot_bp_mean_mag", "VTmag", "BTmag", "Rmag", "RPmag", "r_mag", "r", "Vmag")


def magnitude_column(columns: Sequence[str], wanted: str | None = None, preference: Sequence[str] = MAGNITUDES) -> str:
    """The wanted column, else the first preferred one, else the first with `mag` in its name."""
    for name in ([wanted] if wanted else []) + [*preference]:
        if name in columns:
            return name
    found = next((c for c in columns if "mag" in c.lower()), None)
    if found is None:
        raise KeyError(f"no magnitude among {', '.join(columns)}")
    return found


def mask_radius(m: Column, rules: Sequence[ConstRule | LineRule] = RULES, search_arcmin: float = 1.5) -> Column:
    """Arcseconds about a star inside which its rules reject: the whole search radius by a constant rule, the distance
    where the line meets the magnitude by a line rule, 0 where none does."""
    most, out = search_arcmin * 60.0, F.lit(0.0)
    for r in rules:
        reach = F.when(m <= r.limit, F.lit(most)) if isinstance(r, ConstRule) else (m - r.offset) / r.slope
        out = F.greatest(out, F.least(F.lit(most), F.coalesce(reach, F.lit(0.0))))
    return out
