from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.plans import master, sqlapi
from skysieve.sources import ldac, maps, schema, tables, votable
from skysieve.streaming import incremental


def test_profiles():
    assert schema.resolve(["ra", "dec", "ALPHA_J2000", "DELTA_J2000"], "veto") == ("ALPHA_J2000", "DELTA_J2000")
    assert schema.resolve(["RA", "DEC", "Y_WORLD", "Dec_corr"], "master") == ("RA", "Dec_corr")
    assert schema.resolve(["ra", "dec", "x", "y"], "veto", ("x", "y")) == ("x", "y")
    with pytest.raises(schema.MissingColumns):
        schema.resolve(["Ra", "Dec"], "within5-cat")
    assert schema.object_id(["objID", "number"]) == "number" and schema.row_key(["row_id"]) == "row_id"


def test_lenient_csv(spark, tmp_path):
    a, b = tmp_path / "tile_RA10.000-DEC+1.000", tmp_path / "b" / "tile_RA10.000-DEC+1.000"
    a.mkdir(), b.mkdir(parents=True)
    (a / "x.csv").write_text("﻿NUMBER , ra,dec\n1,10.0,1.0\n2,bad,1.0\n", encoding="utf-8")
    (b / "x.csv").write_text("NUMBER,ra,dec\n1,10.0,1.0\n")
    df = tables.read_csv(spark, str(a / "x.csv"))
    assert df.columns == ["NUMBER", "ra", "dec"] and df.count() == 2
    tiles = tables.read_tiles(spark, [str(a / "x.csv"), str(b / "x.csv")])
    assert tiles.select("image_catalog_path").distinct().count() == 1
    both = tables.union_by_name([df, df.withColumn("z", F.lit("q"))])
    assert both.columns == ["NUMBER", "ra", "dec", "z"] and both.count() == 4


def test_chunks(spark, tmp_path):
    df = spark.range(1_050).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    assert tables.write_chunks(df, str(tmp_path / "c"), "k", 500, width=5) == 1_050
    got = {p.name: sum(1 for f in p.glob("*.csv") for _ in open(f)) - len([*p.glob("*.csv")]) for p in (tmp_path / "c").glob("chunk=*")}
    assert got == {"chunk=00001": 500, "chunk=00002": 500, "chunk=00003": 50}


@pytest.mark.parametrize("advisory", ["1k", "64m"])
def test_numbered_keeps_wide_rows(spark, monkeypatch, advisory):
    """Partitions of wide and of narrow rows are merged differently; each row still gets its place."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        df = spark.range(60_000).select("id", F.concat(F.sha2(F.col("id").cast("string"), 256), F.sha2(F.lit("x"), 256)).alias("wide"))
        got = tables.numbered(df, "id", 1_000)
        assert got.count() == 60_000
        assert got.where("chunk <> id DIV 1000 + 1").isEmpty()
        hot = tables.numbered(df.withColumn("k", F.lit(1)), "k", 1_000).groupBy("chunk").count()
        assert hot.count() == 60 and hot.where("count <> 1000").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_full_file_and_chunks_only_above_the_size(spark, tmp_path):
    df = spark.range(1_000).withColumnRenamed("id", "k")
    assert tables.write_full_and_chunks(df, str(tmp_path / "a"), "k", 1_000) == (1_000, 0)
    assert not (tmp_path / "a" / "chunks").exists()
    assert tables.write_full_and_chunks(df, str(tmp_path / "b"), "k", 300) == (1_000, 4)
    full = spark.read.option("header", True).csv(str(tmp_path / "b" / "full"))
    assert full.count() == 1_000 and sorted(p.name for p in (tmp_path / "b" / "chunks").glob("chunk=*")) == [f"chunk={k:07d}" for k in range(1, 5)]
    assert tables.write_full_and_chunks(df.limit(0), str(tmp_path / "c"), "k", 300) == (0, 0)


def test_plate_scan(spark, tmp_path):
    spark.dataSource.register(maps.PlateScanSource)
    words = np.arange(39 * 8, dtype="i4").reshape(8, 39)
    words[0, 34:39] = -1
    for order, name in ((">", "big"), ("<", "little")):
        raw = words.astype(f"{order}i4").tobytes()
        (tmp_path / f"{name}.dat").write_bytes(raw)
        with gzip.open(tmp_path / f"{name}.gz", "wb") as f:
            f.write(raw)
        paths = ",".join(sorted(map(str, tmp_path.glob(f"{name}*"))))
        df = spark.read.format("platescan").option("paths", paths).option("byteorder", name).load()
        assert df.count() == 14 and df.where("record = 0").first()["w01"] == 40
        assert df.groupBy("record").agg(F.count_distinct("w05").alias("n")).where("n <> 1").isEmpty()
    (tmp_path / "bad.dat").write_bytes(b"x" * 200)
    with pytest.raises(Exception, match="record"):
        spark.read.format("platescan").option("paths", str(tmp_path / "bad.dat")).load().count()


def test_votable(spark, tmp_path):
    head = '<VOTABLE xmlns="http://x"><RESOURCE>'
    rows = "<TABLE><FIELD ID='_raj2000' name='r'/><FIELD name='RA'/><FIELD name='DEC'/><FIELD ID='_decj2000' name='d'/><DATA><TABLEDATA><TR><TD>10.5</TD><TD/><TD/><TD>-5</TD></TR><TR><TD></TD><TD>01 30 00</TD><TD>-00 30 00</TD><TD></TD></TR><TR><TD>999</TD><TD/><TD/><TD>1</TD></TR></TABLEDATA></DATA></TABLE>"
    ok = '<INFO name="QUERY_STATUS" value="OK"/>'
    (tmp_path / "a.xml").write_text(f"{head}{ok}{rows}</RESOURCE></VOTABLE>")
    (tmp_path / "b.xml").write_text(f'{head}{ok}<INFO name="QUERY_STATUS" value="ERROR">No solar system object was found</INFO></RESOURCE></VOTABLE>')
    (tmp_path / "c.xml").write_text(f'{head}{ok}<INFO name="QUERY_STATUS" value="ERROR">broken</INFO></RESOURCE></VOTABLE>')
    df = votable.read_votables(spark, str(tmp_path))
    got = {r["file"][-5:]: r["s"] for r in df.select("file", votable.status(F.col("xml")).alias("s")).collect()}
    assert got == {"a.xml": "OK", "b.xml": "EMPTY", "c.xml": "ERROR"}
    cells = votable.rows(df, ["_raj2000", "_decj2000", "RA", "DEC", "nope"])
    assert [(r["ra"], r["dec"], r["nope"]) for r in votable.positions(cells).orderBy("row").collect()] == [(10.5, -5.0, None), (22.5, -0.5, None)]


def _fits(name: str, columns, rows: np.ndarray) -> bytes:
    def block(cards):
        raw = "".join(c.ljust(80) for c in [*cards, "END"]).encode()
        return raw + b" " * (-len(raw) % ldac.BLOCK)

    cards = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {rows.dtype.itemsize}", f"NAXIS2  = {len(rows)}", "PCOUNT  = 0", f"TFIELDS = {len(columns)}", f"EXTNAME = '{name}'"]
    for k, (n, form) in enumerate(columns, 1):
        cards += [f"TTYPE{k}".ljust(8) + f"= '{n}'", f"TFORM{k}".ljust(8) + f"= '{form}'"]
    data = rows.tobytes()
    return block(cards) + data + b"\0" * (-len(data) % ldac.BLOCK)


def test_ldac(spark, tmp_path):
    spark.dataSource.register(ldac.LdacSource)
    kind = np.dtype([("NUMBER", ">i4"), ("ra", ">f8"), ("VIGNET", ">f4", (4,)), ("name", "S3")])
    rows = np.array([(1, 10.5, [1, 2, 3, 4], b"ab"), (2, 11.5, [5, 6, 7, 8], b"xyz")], kind)
    first = b"SIMPLE  =                    T".ljust(80) + b"BITPIX  = 8".ljust(80) + b"NAXIS   = 0".ljust(80) + b"END".ljust(80)
    junk = np.zeros(3, np.dtype([("j", ">i2")]))
    (tmp_path / "a.fits").write_bytes(first.ljust(ldac.BLOCK) + _fits("LDAC_IMHEAD", [("j", "1I")], junk) + _fits("LDAC_OBJECTS", [("NUMBER", "1J"), ("ra", "1D"), ("VIGNET", "4E"), ("name", "3A")], rows))
    df = spark.read.format("ldac").option("paths", str(tmp_path / "a.fits")).load()
    got = df.orderBy("NUMBER").collect()
    assert [(r["NUMBER"], r["ra"], r["VIGNET"], r["name"]) for r in got] == [(1, 10.5, [1.0, 2.0, 3.0, 4.0], "ab"), (2, 11.5, [5.0, 6.0, 7.0, 8.0], "xyz")]
    assert "VIGNET" not in tables.without_arrays(df).columns


def test_headers_and_text(spark, tmp_path):
    from skysieve.operators import plates

    for k, region in enumerate(["XE001", "XE002", "XE001"]):
        (tmp_path / f"h{k}.json").write_text(json.dumps({"header": {"REGION": region, "SURVEY": "POSSI-E", "DATE-OBS": f"195{k}-01-02T03:04:05", "PLATERA": 10.0 + k, "PLATEDEC": 5.0, "NAXIS1": 14000, "NAXIS2": 13999, "PLTSCALE": 67.2, "XPIXELSZ": 25.0, "YPIXELSZ": 25.0}}))
    heads = tables.read_headers(spark, str(tmp_path / "*.json"))
    got = {r["plate_id"]: r["ra0"] for r in plates.plate_table(heads).collect()}
    assert got == {"XE001": 10.0, "XE002": 11.0}
    assert {r["plate_id"]: r["date_obs_iso"][:4] for r in plates.plate_epochs(heads).collect()} == {"XE001": "1950", "XE002": "1951"}
    (tmp_path / "r.txt").write_text("A: 1\nB: x: y\nno\n")
    assert {(r["key"], r["value"]) for r in tables.read_sidecar(spark, str(tmp_path / "r.txt")).collect()} == {("A", "1"), ("B", "x: y")}
    assert tables.scrape(spark, str(tmp_path / "r.txt"), {"a": r"A: (\d+)", "z": r"Z: (\d+)"}).first()[1:] == ("1", None)
    assert tables.read_fixed_width(spark, str(tmp_path / "r.txt"), {"k": (1, 1, "string"), "v": (4, 2, "int")}).first() == ("A", 1)


def _tile(spark, tile, n):
    return spark.createDataFrame([(tile, str(k), "10.%04d" % (k * 7), "5.0", "0", "12.5") for k in range(n)], "tile_id string, NUMBER string, RA_corr string, Dec_corr string, FLAGS string, MAG_AUTO string")


def test_publish(spark, tmp_path):
    path = str(tmp_path / "master")
    master.publish(master.merge_tiles(_tile(spark, "t1", 5)), path)
    master.publish(master.merge_tiles(_tile(spark, "t1", 9).unionByName(_tile(spark, "t2", 3))), path)
    count = lambda: {r["tile_id"]: r["count"] for r in spark.read.parquet(path).groupBy("tile_id").count().collect()}
    assert count() == {"t1": 5, "t2": 3}
    master.publish(master.merge_tiles(_tile(spark, "t1", 9)), path, overwrite_tile="t1")
    assert count() == {"t1": 9, "t2": 3}
    with pytest.raises(master.PublishError):
        master.publish(master.merge_tiles(_tile(spark, "t1", 9)), path, overwrite_tile="t7")


def test_delta(spark, tmp_path):
    src, manifest, out = str(tmp_path / "in"), str(tmp_path / "manifest"), str(tmp_path / "out")
    rows = spark.createDataFrame([("t", k, 1.0 * k, 2.0) for k in range(7)], "tile_id string, NUMBER int, ra double, dec double")
    rows.coalesce(1).write.parquet(src)
    assert master.extract_delta(spark, src, manifest, out, dry_run=True) == {"changed": 1, "rows": 0}
    assert master.extract_delta(spark, src, manifest, out) == {"changed": 1, "rows": 7}
    assert master.extract_delta(spark, src, manifest, out) == {"changed": 0, "rows": 0}
    rows.limit(2).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(master.PublishError):
        master.extract_delta(spark, src, manifest, out, most_changed=0)
    assert master.extract_delta(spark, src, manifest, str(tmp_path / "out2"))["rows"] == 2


def test_stream(spark, tmp_path):
    from skysieve.plans import stages

    rows = spark.createDataFrame([(f"s{k}", 10.0 + k / 100, 1.0) for k in range(10)], "src_id string, ra double, dec double")
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    rows.limit(6).write.parquet(src)
    run = lambda: incremental.run_stage(incremental.new_files(spark, src, "src_id string, ra double, dec double"), lambda d: stages.scos_stage(d, rows.limit(3)), out, check).awaitTermination()
    run()
    rows.where("src_id >= 's6'").write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(f"{out}/flags").count() == 10 and spark.read.parquet(f"{out}/kept").count() == 3


def test_sql(spark):
    sqlapi.register(spark)
    spark.createDataFrame([("t:1", 10.0, 0.0)], "row_id string, ra double, dec double").createOrReplaceTempView("a")
    spark.createDataFrame([("x", 10.0, 1.0 / 3600)], "oid string, ra double, dec double").createOrReplaceTempView("b")
    sqlapi.view_pairs(spark, "met", "a", "b", 2.0)
    row = spark.sql("SELECT row_tile(row_id), round(sky_sep(10, 0, 10, 1), 6), sky_ra_bin(359), sky_dec_bin(-90), is_true('Yes'), oid FROM met").first()
    assert tuple(row) == ("t", 3600.0, 71, 0, True, "x")


def test_headers_of_a_mixed_folder(spark, tmp_path):
    """Each file is read by its own shape and encoding."""
    whole = {
        "header": b'{"header": {"REGION": "A", "N": 1}, "selected": {"REGION": "no"}, "REGION": "root"}',
        "selected": b'{"header": [1], "selected": {"REGION": "B", "file": "f.fits"}}',
        "root": b'{"REGION": "C", "region": "c", "PLATERA": 10.25, "list": [1, 2]}',
        "tab": b'{"header": {"REGION": "D\tE"}}',
        "bom": b'\xef\xbb\xbf{"REGION": "F\xc3\xa9"}',
        "latin": b'{"REGION": "G\xe9"}',
        "control": b'{"REGION":\x01 "H"}',
        "empty_header": b'{"header": {}, "REGION": "no"}',
        "broken": b'{"REGION": ',
        "none": b"",
    }
    for name, raw in whole.items():
        (tmp_path / f"{name}.json").write_bytes(raw)
    heads = tables.read_headers(spark, str(tmp_path / "*.json"))
    assert {c.lower() for c in heads.columns} == {"file", "region", "n", "header_file", "platera", "list"}
    got = {r["file"].rsplit("/", 1)[1][:-5]: r for r in heads.collect()}
    assert {k: r["REGION"] for k, r in got.items()} == {"header": "A", "selected": "B", "root": "C", "tab": "D\tE", "bom": "Fé", "latin": "Gé", "control": "H", "empty_header": None, "broken": None}
    assert got["header"]["N"] == "1" and got["selected"]["header_file"] == "f.fits" and got["root"]["PLATERA"] == "10.25" and got["root"]["list"] == "[1,2]"


def test_uploads_by_chunk(spark, tmp_path):
    """Every row is in one table of its chunk; a task that fails leaves no table."""
    rows = [(f"id{k:04d}" if k else "a<&>é" + "x" * 40, k / 7.0, -k / 9.0) for k in range(250)] + [("none", None, 1.0), ("nan", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "row_id string, ra double, dec double").repartition(5)
    votable.write_uploads(df, str(tmp_path / "u"), 100)
    files = sorted((tmp_path / "u").glob("chunk=*/*.txt"))
    assert [f.parent.name for f in files] == ["chunk=1", "chunk=2", "chunk=3"]
    back = votable.rows(votable.read_votables(spark, str(tmp_path / "u" / "*")), ["row_id", "ra", "dec"]).collect()
    assert sorted((r["row_id"], float(r["ra"]), float(r["dec"])) for r in back) == sorted([("a&lt;&amp;&gt;?" + "x" * 19, 0.0, 0.0)] + [(r[0], r[1], r[2]) for r in rows[1:250]])
    bad = df.withColumn("ra", F.when(F.col("row_id") == "id0200", F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("ra")))
    with pytest.raises(Exception, match="stop"):
        votable.write_uploads(bad, str(tmp_path / "v"), 100)
    assert not list((tmp_path / "v").rglob("*.txt"))


def test_votable_is_parsed_once_a_file(spark, tmp_path):
    """No row of a table parses its file again: XPath stands below the generator of rows."""
    (tmp_path / "t.xml").write_text('<VOTABLE><TABLE><FIELD name="a"/><FIELD ID="b" name="c"/><TR><TD>1</TD><TD>x</TD></TR><TR><TD/><TD> </TD></TR></TABLE></VOTABLE>')
    read = votable.rows(votable.read_votables(spark, str(tmp_path)), ["a", "b", "c", "d"])
    above, found, below = read._jdf.queryExecution().optimizedPlan().toString().partition("Generate ")
    assert found and "XPath" not in above and "XPath" in below
    assert sorted((r["row"], r["a"], r["b"], r["c"], r["d"]) for r in read.collect()) == [(1, "1", "x", "x", None), (2, None, None, None, None)]
