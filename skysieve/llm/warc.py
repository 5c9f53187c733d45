r"""A content-addressed WARC archive.

Payload bytes are stored once by SHA-256; the record with the largest id of those that share a payload is the response,
the others are revisits of it. The archive is a set of WARC/1.1 files in shared storage, one gzip member a record, written
and committed by Spark's own writer, so a lost executor only repeats its files. Members are parted by an empty gzip member
with a comment, MARK: to gzip readers it is nothing, to Spark's line reader it is the line end, so files of any size are
read in splits, record by record. Reading checks every length and digest and gives exact record headers (bytes as they
stood), and payloads by digest. Original records come back by joining the two.

Choosing responses aggregates (digest, id) with map-side combine, so a payload that a third of all rows share is one row a
task. Payloads travel compressed, and once each: by digest, with their copies combined before the shuffle. Where records
meet their payloads again, digests that many records share are salted.

Defined cases: a null payload is an empty one; records under `least` payload bytes are always responses; with equal ids
that share a payload the one with the larger row number is the response; null urls are written as `urn:null`; line
ends in urls are percent-encoded, ids as in forms; a null id comes back as null; an empty table gives an empty archive and
table. A record and its payload are bounded by what one Spark row holds.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.llm.common import hot_keys, salted_join, salted_lookup, shared_dir, stored, table

# Fixed values of the format.
VERSION, DATE = b"WARC/1.1", "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: An empty gzip member with a comment.
MARK = b"\x1f\x8b\x08\x10" + bytes(6) + b"end of record\0" + b"\x03\0" + bytes(8)
#: Copies of a payload that very many records share.
SPREAD = 64


class ArchiveError(ValueError):
    """A record whose length or digest doesn't hold."""


def base32(hex40: Column) -> Column:
    """Upper-case base32 of a 160-bit number given as 40 hex digits: eight groups of 20 bits, four letters each."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(hex40, g * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, s: F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda v: F.concat(letter(v, 15), letter(v, 10), letter(v, 5), letter(v, 0))), "")


def _packed(rows: DataFrame) -> DataFrame:
    """(key, packed): each payload once, compressed for the way."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(x.as_py()) for x in batch.column(1)], pa.binary())], ["key", "packed"])

    return rows.select("key", "payload").mapInArrow(run, "key string, packed binary").groupBy("key").agg(F.first("packed").alias("packed"))


def packed_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(id, head binary, packed binary): header block with its blank line, and the compressed block (revisits: null)."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("urn:null")).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("key"), F.length("payload").cast("long").alias("size"))
    # the rows without payloads, stored once with their numbers: only digests tie them to payloads
    narrow = rows.select("id", "url", "key", "size", F.sha1("payload").alias("sha1")).withColumn("row", F.monotonically_increasing_id())
    narrow = stored(narrow, "rows")
    shared = narrow.where(F.col("size") >= least)
    best = shared.groupBy("key").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("n"))
    named = salted_lookup(shared, best, ["key"], "n", narrow.count(), F.col("row"), SPREAD).drop("n").withColumn("first", F.col("best.row") == F.col("row"))
    alone = narrow.where(F.col("size") < least).withColumns({"best": F.lit(None).cast(named.schema["best"].dataType), "first": F.lit(True)})
    named = named.unionByName(alone)
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    # the row number names the record where ids repeat
    name = lambda key, row: F.concat(F.lit("<urn:record:"), row.cast("string"), F.coalesce(F.concat(F.lit("/"), F.url_encode(key.cast("string"))), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(VERSION.decode() + "\r\n"),
        line("WARC-Type", F.when(F.col("first"), "response").otherwise("revisit")),
        line("WARC-Record-ID", name(F.col("id"), F.col("row"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("X-Payload-SHA256", F.col("key")),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(F.col("first"), F.lit("")).otherwise(F.concat(line("WARC-Refers-To", name(F.col("best.id"), F.col("best.row"))), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("first"), F.col("size")).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )
    headed = named.select("id", "key", "first", F.encode(head, "UTF-8").alias("head"))
    if not least:
        responses = headed.where("first").join(_packed(rows), "key", "left")
    else:  # small payloads have as many responses as records
        responses = salted_join(headed.where("first"), _packed(rows), ["key"], hot_keys(headed.where("first"), ["key"], SPREAD), F.xxhash64("head"), SPREAD)
    return responses.select("id", "head", "packed").unionByName(headed.where("NOT first").select("id", "head", F.lit(None).cast("binary").alias("packed")))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """(id, head binary, payload binary) of the archive's records: header block with its blank line, and block."""
    found = packed_records(pages, id_col, url_col, payload_col, least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_unpacked(x.as_py()) for x in batch.column(2)], pa.binary())], ["id", "head", "payload"])

    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, head binary, payload binary")


def _unpacked(packed: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def member(data: bytes) -> bytes:
    """One gzip member that doesn't hold MARK: where the record does, a block ends in the middle of it."""
    made, pieces = zlib.compressobj(6, zlib.DEFLATED, 31), data.split(MARK)
    out = made.compress(pieces[0])
    for piece in pieces[1:]:
        out += made.compress(MARK[:5]) + made.flush(zlib.Z_SYNC_FLUSH) + made.compress(MARK[5:] + piece)
    out += made.flush()
    if MARK in out:
        raise ArchiveError("a record whose compressed bytes hold the mark")
    return out


def write_archive(found: DataFrame, path: str) -> None:
    """WARC files below `path` from rows with a head and a payload, or a `packed` one."""
    column = "packed" if "packed" in found.columns else "payload"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for head, block in zip(batch.column(0), batch.column(1), strict=True):
                block = _unpacked(block.as_py()) if column == "packed" else block.as_py() or b""
                out.append(member(head.as_py() + block + b"\r\n\r\n"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = found.select("head", column).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", MARK.decode("latin-1")).text(path)


def parse(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header block with its blank line, block) of every record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(VERSION, at):
            raise ArchiveError(f"no record at byte {at}")
        head = data[at : end + 4]
        size = int(fields(head)["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ArchiveError(f"record at byte {at} doesn't have its {size} bytes")
        yield head, block
        at = end + 8 + size


def fields(head: bytes) -> dict[str, str]:
    """Header fields by name."""
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_FIELDS = {"record": pa.string(), "id": pa.string(), "kind": pa.string(), "head": pa.binary(), "key": pa.string(), "size": pa.int64(), "sha1": pa.string(), "to_record": pa.string(), "to": pa.string(), "payload": pa.binary()}


def _id_of(record: str | None) -> str | None:
    """The id in a record's name, null for none."""
    _, slash, key = (record or "").partition("/")
    return unquote_plus(key) if slash else None


def verified(data: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(header block, block, fields) of a gzip member whose length and digests hold."""
    try:
        raw = zlib.decompress(data, 31)
    except zlib.error as error:
        raise ArchiveError(f"a member that isn't whole: {error}") from error
    found = [*parse(raw)]
    if len(found) != 1:
        raise ArchiveError(f"a member of {len(found)} records")
    (head, block), f = found[0], fields(found[0][0])
    if f["WARC-Type"] == "response" and (hashlib.sha256(block).hexdigest() != f["X-Payload-SHA256"] or "sha1:" + sha1_base32(block) != f["WARC-Payload-Digest"]):
        raise ArchiveError(f"{f['WARC-Record-ID']}: the payload isn't its digest's")
    return head, block, f


def read_archive(spark: SparkSession, path: str, with_payload: bool = True, packed: bool = False) -> DataFrame:
    """(record, id, kind, head, key, size, sha1, to_record, to, payload) of every record; blocks are checked against their
    digests. Payloads are those of responses, `packed` ones the whole gzip member."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for data in batch.column(0):
                data = data.as_py()
                head, block, f = verified(data)
                response = f["WARC-Type"] == "response"
                to = f.get("WARC-Refers-To", "")[12:-1] or None
                kept = (data if packed else block) if response and with_payload else None
                record = f["WARC-Record-ID"][12:-1]
                rows.append((record, _id_of(record), f["WARC-Type"], head, f["X-Payload-SHA256"], len(block) if response else int(f["X-Payload-Length"]), f["WARC-Payload-Digest"][5:], to, _id_of(to), kept))
                held += len(head) + len(kept or b"")
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MARK.decode("latin-1")).text(path)
    schema = "record string, id string, kind string, head binary, key string, size long, sha1 string, to_record string, to string, payload binary"
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_FIELDS.values())], [*_FIELDS])


def reconstruct(headers: DataFrame, payloads: DataFrame, packed: bool = False, unique: bool = False) -> DataFrame:
    """`headers` with the payload of each record, joined by digest; digests that many records share are salted.

    `packed` payloads are gzip members of responses; `unique` says that no digest occurs twice among the payloads.
    """
    if not unique:
        payloads = payloads.dropDuplicates(["key"])
    hot = hot_keys(headers, ["key"], SPREAD)
    joined = salted_join(headers, payloads.select("key", "payload"), ["key"], hot, F.xxhash64("id", *(["record"] if "record" in headers.columns else [])), SPREAD)
    if not packed:
        return joined
    place = joined.columns.index("payload")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = block = None  # of the last member: records of a payload come together
        for batch in batches:
            out = []
            for x in batch.column(place):
                x = x.as_py()
                if x is None:
                    raise ArchiveError("a record without its payload")
                if x != data:
                    data, block = x, verified(x)[1]
                out.append(block)
            yield batch.set_column(place, "payload", pa.array(out, pa.binary()))

    return joined.mapInArrow(run, joined.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    path = shared_dir(spark, "warc")
    write_archive(packed_records(pages), path)
    # the headers are kept, the payloads by digest come from the archive as it stands; every record is built from both
    headers = stored(read_archive(spark, path, with_payload=False).select("record", "id", "kind", "to", "key"), "headers")
    whole = reconstruct(headers, read_archive(spark, path, packed=True).where("kind = 'response'"), packed=True, unique=True)
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.expr(f"try_cast({c} AS {kind.simpleString()})")
    return whole.select(number("id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), F.col("kind").alias("record_type"), number("`to`").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, b FROM p),
e AS (SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h, payload_bytes) AS best FROM d),
g AS (SELECT page_id, payload_bytes, best, h, CAST(unnest(range(0, 8)) AS BIGINT) AS k FROM e),
n AS (SELECT page_id, payload_bytes, best, k, CAST(('0x' || substr(h, CAST(k * 5 + 1 AS INTEGER), 5)) AS BIGINT) AS v FROM g),
w AS (SELECT page_id, payload_bytes, best, k,
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 15) & 31 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS INTEGER) + 1, 1)
     || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS INTEGER) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS INTEGER) + 1, 1) AS c FROM n)
SELECT page_id, payload_bytes, string_agg(c, '' ORDER BY k) AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM w GROUP BY page_id, payload_bytes, best
"""
