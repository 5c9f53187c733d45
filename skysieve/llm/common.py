"""Shared plumbing of the corpus operators: shared storage, bounded broadcasts, skew-safe lookups."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast lookup may hold. Broadcasts in this package count their rows first or have a stated bound.
BROADCAST_ROWS = 500_000


#: Rows and bytes of a batch between the JVM and Python, at most; long texts then bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def lean(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches for all plans of this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of the data folder, pruned to `columns` if any are given."""
    lean(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only in a local session without that setting, as in tests, a temporary folder is made and set.
    """
    lean(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="skysieve-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Folders that `stored` has written.
_WRITTEN: set[str] = set()


def sweep(spark: SparkSession) -> None:
    """Deletes what `stored` has written in this application; tables that are still read must be written elsewhere first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in sorted(_WRITTEN):
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.clear()


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to shared storage and read again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    _WRITTEN.add(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are done, by a collection of the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if `df` (cheap to count, few narrow columns) has at most `rows` rows, else a merge-join hint."""
    small = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df.hint("merge")


def drop_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `docs` whose `key` isn't in the one-column table `ids`; rows with a null key stay."""
    return docs.join(bounded(ids.select(key).distinct()), key, "left_anti")


def salted_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, total: int, spread: Column, parts: int = 256) -> DataFrame:
    """Left join with a lookup table that has one row a key, where a key may hold a third of all left rows.

    `right[count]` says how many left rows a key has. Keys with more than total / parts of them are hot: there are
    fewer than `parts` of those, so the list of hot keys is broadcast with a proven bound. Hot left rows are salted by
    `spread` and meet `parts` copies of their lookup row; all other keys join as they are.
    """
    hot = right.where(F.col(count) * F.lit(parts) > F.lit(total))
    marked = left.join(F.broadcast(hot.select(*keys, F.lit(True).alias("__hot"))), list(keys), "left")
    marked = marked.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(F.lit(0))).drop("__hot")
    copies = F.when(F.col(count) * F.lit(parts) > F.lit(total), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return marked.join(right.withColumn("__salt", F.explode(copies)), [*keys, "__salt"], "left").drop("__salt")


def hot_keys(df: DataFrame, keys: Sequence[str], parts: int = 64) -> DataFrame:
    """The keys that hold over 1 / parts of the rows each: fewer than `parts` rows, stored."""
    total = df.count()
    return stored(df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") * F.lit(parts) > F.lit(total)).select(*keys), "hot")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame, spread: Column, parts: int = 64) -> DataFrame:
    """Left join where `hot` (see hot_keys) lists the keys whose left rows are dealt over `parts` copies of the right ones.

    Unlike salted_lookup, the right rows move once: the list of hot keys, bounded by `parts`, goes to both sides.
    """
    marks = F.broadcast(hot.select(*keys, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(marks, [*keys], "left").withColumn("__salt", salt).drop("__hot")
    b = right.join(marks, [*keys], "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return a.join(b, [*keys, "__salt"], "left").drop("__salt")


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")) if isinstance(key, str) else F.crc32(key.cast("string").cast("binary")), F.lit(folds))
