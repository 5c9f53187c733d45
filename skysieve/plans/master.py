"""The optical master: merging tiles, publishing, promotion and incremental extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions import sky
from skysieve.functions.text import number, stable_row_id
from skysieve.operators import dedup
from skysieve.sources.schema import resolve

#: Columns of the master that are numbers whatever the file says.
NUMERIC = ("ra", "dec", "FLAGS", "MAG_AUTO", "SNR_WIN", "FWHM_IMAGE", "ELONGATION", "SPREAD_MODEL")


class PublishError(ValueError):
    """A publication that would change what is there already."""


def merge_tiles(rows: DataFrame, tol_arcsec: float = 0.5, profile: str = "master", single: bool = False) -> DataFrame:
    """Detections of many tiles (tile_id, NUMBER, text or number columns) as master rows: resolved positions, typed
    columns, best row a grid cell of each tile, index bins. `single` keeps positions in single precision."""
    ra, dec = resolve(rows.columns, profile)
    typed = rows.withColumn("ra", number(F.col(ra).cast("string"))).withColumn("dec", number(F.col(dec).cast("string")))
    for c in set(NUMERIC) & set(rows.columns) - {"ra", "dec"}:
        typed = typed.withColumn(c, number(F.col(c).cast("string")))
    if single:
        typed = typed.withColumn("ra", F.col("ra").cast("float").cast("double")).withColumn("dec", F.col("dec").cast("float").cast("double"))
    typed = typed.where(sky.finite("ra", "dec"))
    best = dedup.grid_best(typed, tol_arcsec, [F.col("NUMBER")], group=["tile_id"])
    ra_bin, dec_bin = sky.sky_bins_index("ra", "dec")
    return best.withColumn("ra_bin", ra_bin).withColumn("dec_bin", dec_bin)


def publish(master: DataFrame, path: str, overwrite_tile: str | None = None) -> DataFrame:
    """Appends the tiles that aren't there yet, by bins; one named tile may be replaced. Returns what was written."""
    from skysieve.sources.tables import exists

    spark, part = master.sparkSession, ["ra_bin", "dec_bin"]
    new = master
    if exists(spark, path):
        old = spark.read.parquet(path)
        if overwrite_tile is not None:
            changed = master.where(F.col("tile_id") == overwrite_tile)
            if changed.isEmpty():
                raise PublishError(f"{overwrite_tile} isn't among the new rows")
            touched = old.where(F.col("tile_id") == overwrite_tile).select(*part).unionByName(changed.select(*part)).distinct()
            kept = old.join(touched, part, "left_semi").where(F.col("tile_id") != overwrite_tile)
            from skysieve.session import cut

            new = cut(kept.unionByName(changed, allowMissingColumns=True))
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*part).parquet(path)
            return new
        new = master.join(old.select("tile_id").distinct(), "tile_id", "left_anti")
    new.write.mode("append").option("compression", "zstd").partitionBy(*part).parquet(path)
    return new


def promote(old: DataFrame, curated: DataFrame, plates: DataFrame) -> DataFrame:
    """Rows of tiles that the curated master lacks, their plate filled from the lookup where it is blank."""
    missing = old.join(curated.select("tile_id").distinct(), "tile_id", "left_anti")
    lookup = plates.select("tile_id", F.col("plate_id").alias("__plate"))
    filled = missing.join(lookup, "tile_id", "left").withColumn("plate_id", F.coalesce(F.nullif(F.trim("plate_id"), F.lit("")), "__plate"))
    return filled.drop("__plate")


def promotion_summary(promoted: DataFrame) -> DataFrame:
    return promoted.agg(F.count_distinct("tile_id").alias("n_tiles"), F.count("*").alias("n_rows"), F.count_if(F.col("plate_id").isNull() | (F.trim("plate_id") == "")).alias("n_empty_plate"))


def changed_parts(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, size, mtime_ns) that are new or differ from the manifest, with `change`."""
    old = manifest.select("path", F.col("size").alias("__size"), F.col("mtime_ns").alias("__mtime"))
    met = files.join(old, "path", "left")
    change = F.when(F.col("__size").isNull(), "new").when((F.col("size") != F.col("__size")) | (F.col("mtime_ns") != F.col("__mtime")), "changed")
    return met.withColumn("change", change).where(F.col("change").isNotNull()).drop("__size", "__mtime")


def file_signatures(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(path, size, mtime_ns) of files, from the source's metadata; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def extract_delta(spark: SparkSession, path: str, manifest_path: str, out: str, most_changed: int | None = None, dry_run: bool = False, chunk_size: int = 20_000) -> dict:
    """Positions of new and changed files, in numbered chunks; the manifest is replaced after the write succeeded."""
    from skysieve.sources.tables import exists, write_chunks

    files = file_signatures(spark, path)
    known = exists(spark, manifest_path)
    manifest = spark.read.parquet(manifest_path) if known else files.limit(0)
    if known and manifest.isEmpty():
        raise PublishError("the manifest is empty; remove it to start anew")
    changed = [r[0] for r in changed_parts(files, manifest).select("path").collect()]
    if most_changed is not None and len(changed) > most_changed:
        raise PublishError(f"{len(changed)} files changed, more than {most_changed}")
    if dry_run or not changed:
        return {"changed": len(changed), "rows": 0}
    rows = spark.read.parquet(*changed)
    ra, dec = resolve(rows.columns, "remainder")
    positions = rows.select(stable_row_id("tile_id", "NUMBER").alias("row_id"), F.col(ra).cast("double").alias("ra"), F.col(dec).cast("double").alias("dec")).where(sky.finite("ra", "dec")).dropDuplicates(["row_id"])
    from skysieve.session import cut

    positions = cut(positions)
    expected, written = positions.count(), write_chunks(positions, out, "row_id", chunk_size, width=5)
    stored = rows.sparkSession.read.option("header", True).option("recursiveFileLookup", "true").schema("row_id string").csv(out).count()
    if not expected == written == stored:
        raise PublishError(f"{expected} positions, {written} numbered, {stored} in files: the manifest stays as it was")
    cut(files).write.mode("overwrite").parquet(manifest_path)
    return {"changed": len(changed), "rows": written}


def seen(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that have been dealt with, for skipping them on a rerun."""
    return rows.select(*keys).distinct()
