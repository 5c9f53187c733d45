from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from skysieve.llm import warc
from skysieve.llm.common import shared_dir

ROWS = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5\r\nX: y", "WARC/1.1\r\n\r\nnot a record\r\n\r\n"), (6, "http://a/6", "x" * 300_000), (9, "http://a/9", "<p>é</p>")]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({"id": F.lit(0), "key": F.lit("k"), "payload": F.lit(1), "row": F.lit(2)})


def test_round_trip(spark, pages):
    path = shared_dir(spark, "warc")
    found = warc.records(pages)
    want = {(bytes(r["head"]), bytes(r["payload"])) for r in found.collect()}
    warc.write_archive(found, path)
    back = warc.read_archive(spark, path).collect()
    assert {(bytes(r["head"]), bytes(r["payload"] or b"")) for r in back} == want and len(back) == len(ROWS)
    whole = warc.reconstruct(warc.read_archive(spark, path).select("id", "kind", "to", "head", "key"), warc.read_archive(spark, path).where("kind = 'response'").select("key", "payload")).collect()
    bodies = {str(i): (h or "").encode() for i, _, h in ROWS}
    assert {r["id"]: bytes(r["payload"]) for r in whole} == bodies


def test_files_are_warc(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(warc.records(pages).coalesce(1), path)
    (file,) = (tmp_path / "w").glob("part-*")
    parsed = [*warc.parse(gzip.decompress(file.read_bytes()))]
    assert len(parsed) == len(ROWS)
    with pytest.raises(warc.ArchiveError):
        [*warc.parse(gzip.decompress(file.read_bytes())[:-9])]
    members = file.read_bytes().split(warc.MARK)
    assert len(members) == len(ROWS) + 1 and not members[-1] and all(len([*warc.parse(gzip.decompress(m))]) == 1 for m in members[:-1])


def test_references_name_records_and_records_rebuild(spark, tmp_path):
    rows = [(f"{k}/a b>\r\n{k % 5}", f"http://x/{k}", f"body {k % 5}" * (k % 5)) for k in range(40)] + [(None, None, None), (None, None, "one")]
    found = spark.createDataFrame(rows, "page_id string, url string, html string")
    path = shared_dir(spark, "warc")
    warc.write_archive(warc.packed_records(found), path)
    back = warc.read_archive(spark, path).collect()
    by = {r["record"]: r for r in back}
    assert len(by) == len(back) == len(rows) and sorted(str(r["id"]) for r in back) == sorted(str(r[0]) for r in rows)
    for r in back:
        if r["kind"] == "revisit":
            target = by[r["to_record"]]
            assert target["kind"] == "response" and target["key"] == r["key"] and target["id"] == r["to"]
    packed = warc.read_archive(spark, path, packed=True)
    whole = warc.reconstruct(packed.drop("payload"), packed.where("kind = 'response'"), packed=True, unique=True).collect()
    assert sorted((str(r["id"]), bytes(r["payload"])) for r in whole) == sorted((str(i), (h or "").encode()) for i, _, h in rows)


def test_a_mark_inside_a_payload():
    import random

    raw = random.Random(1).randbytes(2_000) + warc.MARK + random.Random(2).randbytes(2_000)
    made = warc.member(raw)
    assert warc.MARK not in made and gzip.decompress(made) == raw


def test_a_damaged_archive_is_refused(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(warc.records(pages).coalesce(1), path)
    (file,) = (tmp_path / "w").glob("part-*")
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(bytes(data))
    for crc in (tmp_path / "w").glob(".part-*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="ArchiveError"):
        warc.read_archive(spark, path).collect()


def test_a_very_long_payload(spark, tmp_path):
    body = F.when(F.col("page_id") < 3, F.repeat(F.lit("a long line é\n"), 3_000_000)).otherwise("short")
    spark.range(1, 4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), body.alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    long = "a long line é\n".encode() * 3_000_000
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in warc.op4(spark, str(tmp_path)).collect()}
    assert got[1] == (len(long), warc.sha1_base32(long), "revisit") and got[2][2] == "response"


def test_query_columns(spark, pages, tmp_path):
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in warc.op4(spark, str(tmp_path)).collect()}
    best: dict = {}
    for i, _, h in ROWS:
        best[h or ""] = max(best.get(h or "", i), i)
    for i, _, h in ROWS:
        b = (h or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        top = best[h or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == i else ("revisit", top))


def test_small_payloads_are_responses(spark, pages):
    kinds = {r["id"]: warc.fields(bytes(r["head"]))["WARC-Type"] for r in warc.records(pages, least=9).collect()}
    assert kinds[3] == kinds[4] == "response" and kinds[1] == "revisit"


def test_repeated_rows_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (None, "u", "same")], "page_id long, url string, html string")
    rows.write.parquet(str(tmp_path / "a" / "pages.parquet"))
    assert sorted(r["record_type"] for r in warc.op4(spark, str(tmp_path / "a")).collect()) == ["response", "revisit", "revisit"]
    rows.limit(0).write.parquet(str(tmp_path / "b" / "pages.parquet"))
    assert warc.op4(spark, str(tmp_path / "b")).count() == 0
