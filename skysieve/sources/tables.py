"""Text and Parquet tables: lenient reads, unions by name, chunked writes, small files through Hadoop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small driver-side file: written under another name, then renamed."""
    p, fs = _path(spark, path)
    temp = p.suffix(".tmp")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    fs.rename(temp, p)


def read_csv(spark: SparkSession, paths: str | Sequence[str], infer: bool = False, skip_bad: bool = False) -> DataFrame:
    """Headered CSV as text columns; names lose byte-order marks and blanks; bad lines are nulls or skipped."""
    df = spark.read.csv(paths if isinstance(paths, str) else [*paths], header=True, inferSchema=infer, mode="DROPMALFORMED" if skip_bad else "PERMISSIVE", enforceSchema=False)
    return df.withColumnsRenamed({c: c.replace("﻿", "").strip() for c in df.columns})


def read_tiles(spark: SparkSession, glob: str) -> DataFrame:
    """Catalogue CSVs of many tiles with their file, tile and image id; a tile in several layouts counts once."""
    df = read_csv(spark, glob)
    named = df.withColumn("image_catalog_path", F.col("_metadata.file_path"))
    named = named.withColumn("tile_id", F.regexp_extract("image_catalog_path", r"(tile[-_]RA[^/]+)", 1)).withColumn("image_id", F.regexp_extract("image_catalog_path", r"([^/]+)\.[^./]+$", 1))
    first = named.select("tile_id", "image_catalog_path").distinct().groupBy("tile_id").agg(F.min("image_catalog_path").alias("image_catalog_path"))
    return named.join(first, ["tile_id", "image_catalog_path"], "left_semi")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of columns, the first table's order first; absent is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    return [p for p in paths if exists(spark, p)]


def read_leaves(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame | None:
    """The Parquet leaves that exist and have the columns, pruned to them; None if there are none."""
    good = [spark.read.parquet(p) for p in existing(spark, paths)]
    good = [d.select(*columns) for d in good if set(columns) <= set(d.columns)]
    return union_by_name(good) if good else None


def numbered(df: DataFrame, order: str, size: int, start: int = 1) -> DataFrame:
    """`df` with chunk, its number by rows in order: places within stored range partitions, and their counts.

    The partitions are stored once, each row with its partition and its place there, so counts and rows can't differ
    whatever adaptive execution merges; rows without a count raise. Ties of `order` are split by a hash of the row.
    """
    from skysieve.session import cut

    spread = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"])
    ranged = df.repartitionByRange(F.col(order), spread).withColumn("__spread", spread).sortWithinPartitions(order, "__spread").drop("__spread")
    stored = cut(ranged.withColumn("__at", F.monotonically_increasing_id()))  # partition << 33 | place within it
    part = F.shiftright("__at", 33)
    counts = stored.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = stored.withColumn("__part", part).join(F.broadcast(before), "__part", "left")  # one row a partition
    place = F.coalesce("__before", F.raise_error(F.lit("a range partition has no count")).cast("long")) + F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("chunk", (F.floor(place / size) + start).cast("int")).drop("__part", "__at", "__before")


def write_chunks(df: DataFrame, path: str, order: str, size: int, width: int = 7, start: int = 1, header: bool = True) -> int:
    """CSV chunks of `size` rows below chunk=<number, padded>; returns the rows written."""
    from skysieve.session import cut

    rows = cut(numbered(df, order, size, start).withColumn("chunk", F.lpad(F.col("chunk").cast("string"), width, "0")))
    rows.repartition("chunk").sortWithinPartitions("chunk", order).write.mode("overwrite").partitionBy("chunk").option("header", header).csv(path)
    return rows.count()


def write_full_and_chunks(df: DataFrame, path: str, order: str, size: int, width: int = 7) -> tuple[int, int]:
    """The whole table as CSV below path/full and, only where it has over `size` rows, chunks from 1 below path/chunks.

    Returns (rows, chunks).
    """
    from skysieve.session import cut

    rows = cut(df)
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/full")
    n = rows.count()
    if n <= size:
        return n, 0
    written = write_chunks(rows, f"{path}/chunks", order, size, width)
    if written != n:
        raise ValueError(f"{written} of {n} rows in chunks")
    return n, -(-n // size)


def without_arrays(df: DataFrame) -> DataFrame:
    """Columns that a text table can hold."""
    return df.select(*[f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "binary")])


def header_maps(spark: SparkSession, glob: str) -> DataFrame:
    """(file, header map<string, string>) of JSON files, each by its own shape: the object `header`, else `selected`, else
    the root. Values are text as written, objects and lists as JSON.

    A file is read as UTF-8 with or without a byte-order mark, else as Latin-1, else as Latin-1 without control characters,
    whichever parses first; control characters within strings are let through. A file that doesn't parse has a null map,
    an empty one no row.
    """
    files = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("file"), "content")
    utf = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "^\uFEFF", ""))
    latin = F.decode("content", "ISO-8859-1")
    scrubbed = F.regexp_replace(latin, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    lenient = {"allowUnquotedControlChars": "true"}
    root = lambda text: F.from_json(text, "map<string,string>", lenient)
    texts = files.withColumn("texts", F.filter(F.array(utf, latin, scrubbed), lambda t: t.isNotNull() & root(t).isNotNull()))
    parsed = texts.select("file", F.get("texts", F.lit(0)).alias("text")).withColumn("part", F.from_json("text", "header map<string,string>, selected map<string,string>", lenient))
    return parsed.select("file", F.coalesce("part.header", "part.selected", root(F.col("text"))).alias("header"))


def read_headers(spark: SparkSession, glob: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Plate headers from JSON files of any shape, one row a file: `file` and a text column for each keyword, or for `keys`.

    Keywords that differ by case only share a column; a keyword called file comes as header_file.
    """
    heads = header_maps(spark, glob)
    if keys is None:
        keys = sorted(r[0] for r in heads.select(F.explode(F.map_keys("header")).alias("k")).distinct().collect())  # keywords, not rows
    by_name: dict[str, list[str]] = {}
    for k in keys:
        by_name.setdefault(k.lower(), []).append(k)
    named = lambda k: "header_file" if k.lower() == "file" else k
    return heads.select("file", *[F.coalesce(*[F.col("header")[k] for k in same]).alias(named(same[0])) for same in by_name.values()])


def read_fixed_width(spark: SparkSession, path: str, columns: dict[str, tuple[int, int, str]]) -> DataFrame:
    """Lines of fixed columns: name -> (first character from 1, length, type)."""
    lines = spark.read.text(path)
    return lines.select(*[F.trim(F.substring("value", a, n)).try_cast(t).alias(c) for c, (a, n, t) in columns.items()])


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of `KEY: value` text files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", ":", 2).alias("p"))
    return lines.where(F.size("p") == 2).select("file", F.trim(F.col("p")[0]).alias("key"), F.trim(F.col("p")[1]).alias("value"))


def scrape(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row a report with the first group of each pattern."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), *[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(c) for c, p in patterns.items()])


def read_ecsv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """A table of commented header lines, one line of names and rows; the delimiter is a blank unless the header names a comma."""
    comma = not spark.read.text(path).where(F.col("value").rlike(r"^#\s*delimiter:\s*['\"]?,")).isEmpty()
    return spark.read.csv(path, sep="," if comma else " ", comment="#", header=True, inferSchema=infer, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_ecsv_or(spark: SparkSession, path: str, other: DataFrame) -> DataFrame:
    """The ECSV table, or `other` (the same table in another format) where the file isn't there."""
    return read_ecsv(spark, path) if exists(spark, path) else other


def row_counts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, n): lines without the header line of each text file; a file without lines has -1."""
    lines = spark.read.text(paths if isinstance(paths, str) else [*paths]).select(F.col("_metadata.file_path").alias("file"))
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else [*paths]).select(F.col("path").alias("file"))
    counted = lines.groupBy("file").agg(F.count("*").alias("n"))
    return files.join(counted, "file", "left").select("file", (F.coalesce("n", F.lit(0)) - 1).alias("n"))


def append_ledger(ledger: DataFrame, path: str) -> None:
    """Rows that are added to a CSV ledger; what it holds stays as it is, and each append is one commit."""
    ledger.coalesce(1).write.mode("append").option("header", True).csv(path)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole, through the session's file systems."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
