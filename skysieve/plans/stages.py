"""Elimination stages and the funnel that chains them.

A stage takes the candidates and returns the kept rows, a flag row for every input row and a lazy ledger of totals.
Nothing runs until a result is used; `Funnel.write` runs each stage once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysieve.functions import sky
from skysieve.operators import filters, skyjoin
from skysieve.operators.skyjoin import count_within, match_best
from skysieve.session import cut


@dataclass
class StageResult:
    kept: DataFrame
    flags: DataFrame
    totals: DataFrame
    parameters: dict = field(default_factory=dict)

    def ledger(self) -> dict:
        """Parameters and totals; runs the counts."""
        return self.parameters | {"totals": self.totals.first().asDict()}


def _result(flags: DataFrame, keep: Column, columns: Sequence[str], counted: Sequence[str], **parameters) -> StageResult:
    totals = flags.agg(F.count("*").alias("n_in"), F.count_if(keep).alias("n_kept"), *[F.count_if(F.col(c)).alias(f"n_{c}") for c in counted])
    return StageResult(flags.where(keep).select(*columns), flags, totals, parameters)


def ps1_stage(rows: DataFrame, catalogue: DataFrame, radius: float = 5.0, south: float | None = 0.0, key: str = "src_id", other: str = "objID") -> StageResult:
    """Best match within the radius; the southern cut comes first, and what it removes is flagged, never matched."""
    cut = F.coalesce(sky.finite("dec") & (F.col("dec") < south), F.lit(False)) if south is not None else F.lit(False)
    marked = rows.withColumn("removed_by_sh_cut", cut)
    best = match_best(marked.where("NOT removed_by_sh_cut").select(key, "ra", "dec"), catalogue.select(other, F.col("ra").alias("ra_c"), F.col("dec").alias("dec_c")), radius, key, other, right_coords=("ra_c", "dec_c"))
    flags = marked.join(best.select(key, F.col("sep_arcsec").alias("best_sep_arcsec")), key, "left").withColumn("has_ps1_match", F.col("best_sep_arcsec").isNotNull())
    return _result(flags, ~F.col("removed_by_sh_cut") & ~F.col("has_ps1_match"), rows.columns, ["removed_by_sh_cut", "has_ps1_match"], stage="PS1SH", radius=radius, south=south)


def usno_stage(rows: DataFrame, catalogue: DataFrame, radius: float = 5.0, key: str = "src_id", other: str = "usno_id") -> StageResult:
    best = match_best(rows.select(key, "ra", "dec"), catalogue.select(other, F.col("ra").alias("ra_c"), F.col("dec").alias("dec_c")), radius, key, other, right_coords=("ra_c", "dec_c"))
    flags = rows.join(best.select(key, F.col("sep_arcsec").alias("best_sep_arcsec")), key, "left").withColumn("has_usnob_match", F.col("best_sep_arcsec").isNotNull())
    return _result(flags, ~F.col("has_usnob_match"), rows.columns, ["has_usnob_match"], stage="USNO", radius=radius)


def scos_stage(rows: DataFrame, catalogue: DataFrame, radius: float = 5.0, mode: str = "keep_matches", key: str = "src_id") -> StageResult:
    """Counts of a second digitisation: a real source is there again, so matches stay unless `drop_matches`."""
    flags = count_within(rows, catalogue, radius, key).withColumn("has_supercosmos_match", F.col("matched_count") > 0)
    keep = F.col("has_supercosmos_match") if mode == "keep_matches" else ~F.col("has_supercosmos_match")
    return _result(flags, keep, rows.columns, ["has_supercosmos_match"], stage="SCOS", radius=radius, mode=mode)


def ptf_stage(rows: DataFrame, catalogue: DataFrame, radius: float = 5.0, key: str = "src_id", good: str = "ngoodobs") -> StageResult:
    """Drops rows with any object of at least one good observation within the radius."""
    hit = skyjoin.semi(rows.select(key, "ra", "dec"), catalogue.where(F.coalesce(F.col(good), F.lit(0)) > 0), radius, key).select(key, F.lit(True).alias("has_ptf_match_ngood"))
    flags = rows.join(hit, key, "left").withColumn("has_ptf_match_ngood", F.coalesce("has_ptf_match_ngood", F.lit(False)))
    return _result(flags, ~F.col("has_ptf_match_ngood"), rows.columns, ["has_ptf_match_ngood"], stage="PTF", radius=radius)


def vsx_stage(rows: DataFrame, catalogue: DataFrame, radius: float = 5.0, key: str = "src_id") -> StageResult:
    flags = count_within(rows, catalogue, radius, key, least="best_sep_arcsec").withColumn("is_known_variable_or_transient", F.col("matched_count") > 0)
    return _result(flags, ~F.col("is_known_variable_or_transient"), rows.columns, ["is_known_variable_or_transient"], stage="VSX", radius=radius)


def fields(rows: DataFrame, step_arcmin: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """(rows with field_id, one row a field: median centre, most frequent epoch (the smallest of several), size)."""
    named = rows.withColumn("field_id", sky.field_bucket("ra", "dec", "plate_id", step_arcmin))
    centres = named.groupBy("field_id").agg(F.median("ra").alias("ra_f"), F.median("dec").alias("dec_f"), F.mode("epoch_iso", True).alias("epoch_iso"), F.mode("epoch_jd", True).alias("epoch_jd"), F.count("*").alias("n"))
    return named, centres


def skybot_stage(rows: DataFrame, objects: DataFrame, strict: float = 5.0, wide: float = 60.0, drop: str = "strict", step_arcmin: float = 60.0, key: str = "src_id", cap: int | None = None, fallback: DataFrame | None = None) -> StageResult:
    """Moving objects of each field: strict and wide matches (wide excludes strict), by flat separations within a field.

    `objects`: field_id, ra_o, dec_o. Fields without objects may look into `fallback` (ra, dec) row by row, strictly,
    for at most `cap` rows in key order.
    """
    named, _ = fields(rows, step_arcmin)
    listed = objects.join(objects.groupBy("field_id").agg(F.median("dec_o").alias("dec_m")), "field_id")
    near = named.select(key, "field_id", "ra", "dec").join(listed, "field_id").withColumn("sep", sky.sep_planar("ra", "dec", "ra_o", "dec_o", "dec_m"))
    best = near.groupBy(key).agg(F.min("sep").alias("best_sep_arcsec"), F.count_if(F.col("sep") <= wide).alias("matched_count"))
    flags = named.join(best, key, "left").withColumn("matched_count", F.coalesce("matched_count", F.lit(0)))
    if fallback is not None:
        empty = flags.join(objects.select("field_id").distinct(), "field_id", "left_anti")
        tried = empty.select(key, "ra", "dec").orderBy(key).limit(cap) if cap is not None else empty.select(key, "ra", "dec")
        extra = count_within(tried, fallback, strict, key, name="f_count", least="f_sep").where("f_count > 0").select(key, "f_sep", "f_count")
        flags = flags.join(extra, key, "left").withColumn("best_sep_arcsec", F.coalesce("best_sep_arcsec", "f_sep")).withColumn("matched_count", F.coalesce("f_count", "matched_count")).drop("f_sep", "f_count")
    flags = flags.withColumn("has_skybot_match", F.coalesce(F.col("best_sep_arcsec") <= strict, F.lit(False)))
    flags = flags.withColumn("wide_skybot_match", ~F.col("has_skybot_match") & F.coalesce(F.col("best_sep_arcsec") <= wide, F.lit(False)))
    flags = flags.withColumn("epoch_used", F.coalesce(F.col("epoch_iso"), F.col("epoch_jd").cast("string")))
    gone = F.col("has_skybot_match") if drop == "strict" else F.col("has_skybot_match") | F.col("wide_skybot_match")
    return _result(flags, ~gone, rows.columns, ["has_skybot_match", "wide_skybot_match"], stage="SKYBOT", strict=strict, wide=wide, drop=drop)


def flag_stage(rows: DataFrame, catalogues: Mapping[str, DataFrame], radius: float = 5.0, key: str = "src_id") -> StageResult:
    """has_<name>_match for each catalogue, and any_match over them. Rows are joined once with the keys that any catalogue met."""
    names, found, flags = {name: f"has_{name}_match" for name in catalogues}, None, rows
    for name, catalogue in catalogues.items():
        slim = catalogue.select(F.col("ra").alias("ra_c"), F.col("dec").alias("dec_c"))
        near = skyjoin.pairs(rows.select(key, "ra", "dec"), slim, radius, right_coords=("ra_c", "dec_c"))
        near = near.select(key, *[F.lit(n == name).alias(c) for n, c in names.items()])
        found = near if found is None else found.unionByName(near)
    if found is not None:
        met = found.groupBy(key).agg(*[F.bool_or(c).alias(c) for c in names.values()])
        flags = rows.join(met, key, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in names.values()})
    flags = flags.withColumn("any_match", filters.any_flag(flags))
    return _result(flags, ~F.col("any_match"), rows.columns, ["any_match"], stage="ANY", radius=radius)


def veto(rows: DataFrame, catalogue: DataFrame, radius: float = 5.0, key: str = "src_id", mode: str = "any", other: str | None = None, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(matched pairs, carried rows). A veto that is switched off, or whose catalogue is empty, carries all rows on."""
    slim = catalogue.select(F.col("ra").alias("ra_c"), F.col("dec").alias("dec_c"), *([F.col(other)] if other else []))
    if not enabled:
        slim = slim.limit(0)
    found = skyjoin.pairs(rows.select(key, "ra", "dec"), slim, radius, right_coords=("ra_c", "dec_c"))
    if mode == "best":
        found = skyjoin.symmetric(found, key, other)
    return found, rows.join(found.select(key), key, "left_anti")


def cascade(rows: DataFrame, catalogues: Sequence[tuple[str, DataFrame]], radius: float = 5.0, key: str = "src_id") -> tuple[DataFrame, DataFrame]:
    """(survivors, accounting): vetoes in order, and for each: rows before and after, eliminated, pairs.

    Each veto joins the sky once: the pairs of each row are counted and checkpointed, the rows without any carry on, and
    the accounting is sums over both.
    """
    now, account = rows, None
    for step, (name, catalogue) in enumerate(catalogues):
        found, _ = veto(now, catalogue, radius, key)
        hit = cut(found.groupBy(key).agg(F.count("*").alias("n")))
        rest = cut(now.join(hit.select(key), key, "left_anti"))
        line = now.agg(F.count("*").alias("n_before")).crossJoin(rest.agg(F.count("*").alias("n_after"))).crossJoin(hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs")))
        line = line.select(F.lit(step + 1).alias("step"), F.lit(name).alias("veto"), "n_before", "n_after", F.greatest(F.lit(0), F.col("n_before") - F.col("n_after")).alias("n_eliminated"), "n_pairs")
        account = line if account is None else account.unionByName(line)
        now = rest
    return now, account


class Funnel:
    """Stages in order: (name, function of the candidates)."""

    def __init__(self, stages: Sequence[tuple[str, Callable[[DataFrame], StageResult]]]) -> None:
        self.stages = stages

    def run(self, rows: DataFrame) -> tuple[DataFrame, dict[str, StageResult]]:
        results = {}
        for name, stage in self.stages:
            results[name] = stage(rows)
            rows = results[name].kept
        return rows, results

    def write(self, rows: DataFrame, path: str) -> dict[str, dict]:
        """Writes flags of each stage and the survivors below `path`; stages that are there already are read, not run."""
        from skysieve.sources.tables import exists, write_text

        spark, ledgers = rows.sparkSession, {}
        for name, stage in self.stages:
            at = f"{path}/{name}"
            if not exists(spark, f"{at}/kept/_SUCCESS"):
                result = stage(rows)
                result.flags.write.mode("overwrite").parquet(f"{at}/flags")
                result.kept.write.mode("overwrite").parquet(f"{at}/kept")
                ledgers[name] = result.ledger()
                write_text(spark, f"{at}/ledger.json", json.dumps(ledgers[name], sort_keys=True, default=str))
            rows = spark.read.parquet(f"{at}/kept")
        return ledgers


#: Tiles that a list may have to be broadcast.
FEW_TILES = 500_000


def _tile_list(table: DataFrame) -> DataFrame:
    """The distinct tiles of a list, stored; up to FEW_TILES are broadcast, so rows needn't move to a few dozen tiles."""
    listed = cut(table.select("tile_id").distinct())
    return F.broadcast(listed) if listed.count() <= FEW_TILES else listed


def build_candidates(tiles: DataFrame, tol_arcsec: float = 0.25, eligible: DataFrame | None = None, edge: DataFrame | None = None) -> dict[str, DataFrame]:
    """The first stage: unique ids, eligibility, one row a cluster within each plate, core tiles, and a manifest.

    `tiles`: tile_id, object_id, ra, dec, plate_id. An empty list of eligible tiles makes every tile eligible.
    """
    from skysieve.functions.text import object_number, source_id
    from skysieve.operators import dedup
    from skysieve.operators.flags import core_only

    # a whole number needn't pass through text to be rounded as a double is
    whole = dict(tiles.dtypes)["object_id"] in ("tinyint", "smallint", "int", "bigint")
    number = F.col("object_id").cast("double").try_cast("bigint") if whole else object_number(F.col("object_id").cast("string"))
    emitted = tiles.withColumn("object_id", number).withColumn("src_id", source_id("tile_id", "object_id")).where(sky.finite("ra", "dec"))
    within = lambda d: d
    if eligible is not None:
        tiles_in = _tile_list(eligible)
        if not tiles_in.isEmpty():
            within = lambda d: d.join(tiles_in, "tile_id", "left_semi")
    first = lambda d: dedup.first_by(d, ["src_id"], [F.col("ra"), F.col("dec")])
    rows = within(first(emitted))
    # Only rows that have a link may be left out, so only ids with a row in a crowded cell are made unique and grouped. An
    # id has one tile, so its rows are eligible together; hashes of ids that clash only let more ids in.
    nameless = F.col("tile_id").isNull() | F.col("object_id").isNull()  # not by src_id, which would be made for each row
    named = emitted.where(~nameless).withColumn("__id", F.xxhash64("tile_id", "object_id"))
    ids = dedup.key_list(dedup.crowded(within(named).select("__id", "ra", "dec", "plate_id"), tol_arcsec, ["plate_id"]).select("__id").distinct())
    near = cut(within(first(named.join(ids, "__id", "left_semi"))).select("src_id", "ra", "dec", "plate_id"))
    links = dedup.links(near, tol_arcsec, "src_id", ["plate_id"])
    if edge is not None:
        core = _tile_list(core_only(edge, edge)).withColumn("is_core", F.lit(True))
        with_core = lambda d: d.join(core, "tile_id", "left").withColumn("is_core", F.coalesce("is_core", F.lit(False)))
    else:
        with_core = lambda d: d.withColumn("is_core", F.lit(True))
    # an id ends with its number and begins with its tile
    linked = with_core(links.select("src_id", "cluster_id", F.regexp_extract("src_id", r"(?s)^(.*):[^:]*$", 1).alias("tile_id")))
    reps = dedup.representatives(linked, "src_id", F.col("is_core"))
    marked = cut(linked.join(reps, "cluster_id").select("src_id", "cluster_id", "tile_id", (F.col("src_id") == F.col("rep_id")).alias("is_rep")))
    clustered = with_core(rows.join(marked.drop("tile_id"), "src_id", "left")).withColumn("cluster_id", F.coalesce("cluster_id", "src_id")).withColumn("is_rep", F.coalesce("is_rep", F.col("src_id").isNotNull()))
    kept = clustered.where("is_rep")
    # What tiles emit counts before ids that repeat go. Of rows without a number the first stays, and is never kept.
    by_id = within(emitted).groupBy("tile_id", "object_id").agg(F.count("*").alias("n"))
    by_tile = with_core(by_id.groupBy("tile_id").agg(F.sum("n").alias("n_emitted"), F.count("object_id").alias("n_ids")))
    unnamed = within(first(emitted.where(nameless))).select("tile_id", F.lit(1).alias("n_unnamed"))
    left_out = marked.where("NOT is_rep").groupBy("tile_id").agg(F.count("*").alias("n_out"))
    counted = by_tile.join(unnamed, "tile_id", "left").join(left_out, "tile_id", "left").fillna(0, ["n_unnamed", "n_out"]).withColumn("n_rows", F.col("n_ids") + F.col("n_unnamed"))
    manifest = counted.where("tile_id IS NOT NULL AND n_rows > 0").select("tile_id", "n_rows", (F.col("n_ids") - F.col("n_out")).alias("n_kept"), F.when(F.col("is_core"), F.col("n_rows")).otherwise(F.lit(0)).alias("n_core"), "n_emitted")
    columns = ["src_id", "tile_id", "object_id", "ra", "dec"]
    return {"stage": kept.where("is_core").select(*columns), "all": kept.select(*columns, "is_core"), "upload": kept.where("is_core").select("src_id", "ra", "dec"), "members": clustered.select("src_id", "cluster_id", "is_core"), "manifest": manifest}
