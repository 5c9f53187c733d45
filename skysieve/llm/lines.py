r"""Removal of lines that many documents share, by two Bloom filters and an exact count of the suspects.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Pass one sends each document's
distinct keys through once-seen and twice-seen filters; a key found in two documents is always twice-seen. Pass two
shuffles only the twice-seen keys, as 16-byte digests, and counts their documents exactly (with map-side
combine, so a line in a third of all documents is one row a task). Pass three rewrites the texts row by row.

Defined cases: a null or empty text is one empty line and comes back as it was, null or empty, where nothing was
dropped; keys under `least_chars` code points never go; a line repeated inside one document counts once; repeated
rows are documents of their own. Other columns pass unchanged whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from skysieve.llm.bloom import bits_for, seen, twice_seen
from skysieve.llm.common import BROADCAST_ROWS, salted_lookup, stored, table

_ENDS = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    return line.strip(_ENDS).lower()


def digest_of(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _keys(text: bytes | None, least: int) -> set[bytes]:
    """Distinct keys of a document that may go; a strip or lower in bulk would move line ends, so line by line."""
    found = set(map(key_of, (text or b"").split(b"\n")))
    found.discard(b"")
    return {k for k in found if _code_points(k) >= least} if least > 1 else found


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def frequent_lines(docs: DataFrame, text_col: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(digest, n): keys of at least `least_docs` documents with their exact document counts."""
    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    ends = texts.agg(F.sum(F.length("text") - F.length(F.replace(F.col("text").cast("string"), F.lit("\n"))) + 1), F.count("*")).first()
    bits = bits_for(max(ends[0] or 0, ends[1] or 0))

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return _hashes([digest_of(k) for x in batch.column(0) for k in _keys(x.as_py(), least_chars)])

    twice = docs.sparkSession.sparkContext.broadcast(twice_seen(texts, hashes, bits))  # at most 64 MB

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [digest_of(k) for x in batch.column(0) for k in _keys(x.as_py(), least_chars)]
            if digests:
                keep = np.nonzero(seen(twice.value, bits, _hashes(digests)))[0]
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in keep.tolist()], pa.binary())], ["digest"])

    counted = texts.mapInArrow(suspects, "digest binary").groupBy("digest").agg(F.count("*").alias("n"))
    return stored(counted.where(F.col("n") >= least_docs), "lines")


def strip_text(text: bytes | None, digests: Iterable[bytes], least_chars: int = 1) -> tuple[int, int, bytes]:
    """(lines, dropped lines, remaining text)."""
    lines, kept = (text or b"").split(b"\n"), []
    for line in lines:
        key = key_of(line)
        if not key or _code_points(key) < least_chars or digest_of(key) not in digests:
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def strip_lines(docs: DataFrame, frequent: DataFrame, text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """`docs` with n_lines, n_dropped and the rewritten text in structs: columns `row` (all of docs) and `stripped`.

    Up to BROADCAST_ROWS digests go to the tasks as a set; beyond that each document's own digests are joined.
    """
    few = frequent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    schema = StructType([rows.schema["row"], StructField("stripped", DataType.fromDDL("n_lines long, n_dropped long, text string"))])
    if few:
        banned = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in frequent.select("digest").collect()))
        rows = rows.withColumn("digests", F.lit(None).cast("array<binary>"))
    else:
        banned = None

        def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [[digest_of(k) for k in _keys(x.as_py(), least_chars)] for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["number", "digests"])

        rows = stored(rows.withColumn("number", F.monotonically_increasing_id()), "rows")
        hits = rows.select("number", "text").mapInArrow(digests, "number long, digests array<binary>").select("number", F.explode("digests").alias("digest"))
        total = frequent.agg(F.sum("n")).first()[0]
        hits = salted_lookup(hits, frequent, ["digest"], "n", total, F.col("number")).where(F.col("n").isNotNull())
        hits = hits.groupBy("number").agg(F.collect_list("digest").alias("digests"))
        rows = rows.join(hits.hint("merge"), "number", "left").drop("number")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (banned.value for _ in range(len(batch))) if banned else (frozenset(x or ()) for x in batch.column(2).to_pylist())
            found = [strip_text(x.as_py(), s, least_chars) for x, s in zip(batch.column(1), sets, strict=True)]
            texts = pa.array([t.decode() if d or x.is_valid else None for (_, d, t), x in zip(found, batch.column(1), strict=True)], pa.string())
            stripped = pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), texts], ["n_lines", "n_dropped", "text"])
            yield pa.RecordBatch.from_arrays([batch.column(0), stripped], ["row", "stripped"])

    return rows.select("row", "text", "digests").mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, text_col: str = "text", least_docs: int = 10, least_chars: int = 1, length_col: str | None = None) -> DataFrame:
    """`docs`, all columns, with `text_col` rewritten and `length_col`, if named, set to its code points."""
    done = strip_lines(docs, frequent_lines(docs, text_col, least_docs, least_chars), text_col, least_chars)
    text = F.col("stripped.text")
    new = {text_col: text} | ({length_col: F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[length_col].dataType)} if length_col in docs.columns else {})
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    done = strip_lines(docs, frequent_lines(docs))
    kept = F.sha2(F.coalesce("stripped.text", F.lit("")), 256)
    return done.select("row.doc_id", "stripped.n_lines", "stripped.n_dropped", kept.alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, l, lower_ascii, rid FROM (
    SELECT doc_id, rid, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l,
           unnest(list_transform(ls, lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS lower_ascii
    FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
frequent AS (SELECT lower_ascii FROM lines WHERE length(lower_ascii) >= 1 GROUP BY 1 HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.lower_ascii) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE f.lower_ascii IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f USING (lower_ascii) GROUP BY rid, doc_id
"""
