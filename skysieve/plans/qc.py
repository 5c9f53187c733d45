"""Quality summaries: chunks, whole tables, runs, stages, jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions import sky
from skysieve.functions.sky import finite
from skysieve.operators import quantiles as select


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage; 0 of nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def distances(df: DataFrame, value: str, group: Sequence[str] = (), quantiles: Sequence[float] = (0.5, 0.9, 0.95), large: bool = False) -> DataFrame:
    """Count, extremes, mean and interpolated quantiles of a column's finite values. Scopes that may hold much of a table
    (all rows at once, or `large` groups) are selected by rank; the others are one aggregate."""
    x = F.when(finite(value), F.col(value))
    plain = [F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean")]
    if group and not large:
        return df.groupBy(*group).agg(*plain, *[F.percentile(x, F.lit(q)).alias(select.name_of(q)) for q in quantiles])
    names = [select.name_of(q) for q in quantiles]
    facts, ranks = df.groupBy(*group).agg(*plain), select.exact(df, value, quantiles, group)
    ranks = ranks.select(*[F.col(g).alias(f"__{g}") for g in group], *names)
    if not group:
        return facts.crossJoin(F.broadcast(ranks))  # one row each
    return facts.join(ranks, [facts[g].eqNullSafe(ranks[f"__{g}"]) for g in group], "left").select(*group, "n", "min", "max", "mean", *names)


def global_summary(df: DataFrame, strict: Column) -> DataFrame:
    """One row: rows, strict matches and their share, SNR bands, quality counts, epochs, distinct bins."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(strict).alias("n_strict"),
        share(F.count_if(strict), F.count("*")).alias("pct_strict"),
        F.count_if(F.col("w1snr") >= 20).alias("snr_20_up"),
        F.count_if((F.col("w1snr") >= 10) & (F.col("w1snr") < 20)).alias("snr_10_20"),
        F.count_if(F.col("w1snr") < 10).alias("snr_under_10"),
        F.count_if(F.col("qual_frame") > 0).alias("n_good_frames"),
        F.min("mjd").alias("first_mjd"),
        F.max("mjd").alias("last_mjd"),
        F.count_distinct("ra_bin", "dec_bin").alias("n_bins"),
    )


def run_summary(tiles: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Fleet totals of per-tile counters and each step's share of the first."""
    sums = tiles.agg(F.count("*").alias("n_tiles"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in steps])
    return sums.select("n_tiles", *steps, *[share(F.col(s), F.col(steps[0])).alias(f"pct_{s}") for s in steps[1:]])


def late_survivors(after: str, kept: str) -> Column:
    return F.when(F.col(after) > 0, F.col(after)).when(F.col(kept) > 0, F.col(kept)).otherwise(F.lit(0))


def stage_stats(tiles: DataFrame, value: str, eligible: Column) -> DataFrame:
    """Quantiles of a counter over all, eligible and excluded tiles."""
    scopes = F.array(F.lit("all"), F.when(eligible, "eligible").otherwise("excluded"))
    return distances(tiles.withColumn("scope", F.explode(scopes)), value, ["scope"], (0.5, 0.9), large=True)


def duplicate_centres(tiles: DataFrame, digits: int = 3) -> DataFrame:
    return tiles.groupBy(F.round("ra", digits).alias("ra"), F.round("dec", digits).alias("dec")).agg(F.count("*").alias("n")).where("n > 1")


def top(tiles: DataFrame, value: str, n: int = 10, key: str = "tile_id") -> DataFrame:
    """The n largest finite values, ties to the smaller key."""
    return tiles.where(finite(value)).orderBy(F.desc(value), key).limit(n)


def job_state(closest: Column, raw: Column, meta: Column, phase: Column) -> Column:
    """State of a remote job from what its files and its phase say."""
    done = F.upper(F.coalesce(phase, F.lit("")))
    return (
        F.when(closest, "COMPLETED")
        .when(raw, "PARTIAL")
        .when(meta & (done == "COMPLETED"), "PARTIAL")
        .when(meta & done.isin("ERROR", "ABORTED", ""), "NEED_RESUBMIT")
        .when(meta, "IN_FLIGHT")
        .otherwise("NEW")
    )


def snapshot(flags: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Distinct keys over all and by flag."""
    return flags.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), *[F.count_distinct(F.when(F.col(c), F.col(key))).alias(f"n_{c}") for c in names])


def residual_status(rows: DataFrame, residual: str, median_most: float = 0.3, p90_most: float = 1.0) -> DataFrame:
    stats = distances(rows, residual, (), (0.5, 0.9))
    return stats.withColumn("status", F.when((F.col("p50") <= median_most) & (F.col("p90") <= p90_most), "OK").otherwise("WARN"))


def tripwire(rows: DataFrame, most_deg: float = 1.5) -> DataFrame:
    """Rows farther from the centre in their tile's name than the limit, with the distance in degrees."""
    from skysieve.functions.text import tile_centre

    ra0, dec0 = tile_centre("tile_id")
    far = rows.withColumn("sep_deg", sky.sep_degrees("ra", "dec", ra0, dec0))
    return far.where(F.col("sep_deg") > most_deg)


def tile_status(tiles: DataFrame) -> DataFrame:
    """Warnings of inconsistent steps: a later output without the earlier one."""
    steps = [c for c in ("has_image", "has_catalogue", "has_xmatch", "has_summary") if c in tiles.columns]
    warn = [F.when(F.col(b) & ~F.col(a), F.lit(f"{b} without {a}")) for a, b in zip(steps, steps[1:])]
    return tiles.withColumn("warnings", F.array_compact(F.array(*warn).cast("array<string>"))).withColumn("last_step", F.coalesce(*[F.when(F.col(s), F.lit(s)) for s in reversed(steps)], F.lit("none")))


#: Parts of messages that a service repeats for the same rows, whatever one retries.
DOMAIN_ERRORS = ("field ra < 0 or > 360", "malformed coordinates", "out of range in column ra", "invalid literal for float", "saxparseexception")


def domain_error(message: Column) -> Column:
    """Whether a service's message means a fault of the rows, which no retry mends."""
    said = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for part in DOMAIN_ERRORS:
        out = out | said.contains(part)
    return out


def needs_step(files: DataFrame, sources: str, suffix: str) -> DataFrame:
    """(tile_id, needed) from files (tile_id, name): a step is needed where a tile has no source (a regular expression)
    or a source, without its ending, has no result of that suffix."""
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    made = files.where(F.col("name").endswith(suffix)).select("tile_id", F.expr(f"left(name, length(name) - {len(suffix)})").alias("stem"), F.lit(True).alias("made")).distinct()
    wanted = files.where(F.col("name").rlike(sources) & ~F.col("name").endswith(suffix)).select("tile_id", stem.alias("stem")).distinct()
    state = wanted.join(made, ["tile_id", "stem"], "left").groupBy("tile_id").agg(F.bool_or(F.col("made").isNull()).alias("open"))
    return files.select("tile_id").distinct().join(state, "tile_id", "left").select("tile_id", F.coalesce("open", F.lit(True)).alias("needed"))
