from __future__ import annotations

import pandas as pd

import corpus_pipeline


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs, names = spark.read.parquet(f"{d}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, d)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    bench = pd.read_parquet(f"{d}/benchmark.parquet").text
    texts = [r["text"] or "" for r in out.select("text").collect()]
    assert not any(b in t for b in bench for t in texts) and len(set(texts)) == len(texts)


def test_empty_documents(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_through_every_stage(spark, documents, odd_rows):
    """Nulls, empty and very long texts, ties, repeated rows and clashing column names: each stage keeps the columns, invents no row, and
    does what its module says of such rows."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{d}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = plain.unionByName(documents(odd_rows)).withColumns({"id": F.lit("x"), "row": F.lit(1), "h": F.lit(2), "key": F.lit("k"), "n": F.lit(3), "item": F.lit(4), "p": F.lit(0.5), "copy_of": F.lit("c")})
    whole = {}
    for r in docs.collect():
        whole.setdefault((r["doc_id"], r["id"], r["copy_of"]), set()).add(r["text"])
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = out.collect()
        assert 0 < len(rows) <= docs.count(), name
        for r in rows:
            texts = whole[(r["doc_id"], r["id"], r["copy_of"])]
            assert name == "line_dedup" or r["text"] in texts, name
        kept[name] = [(r["doc_id"], r["text"]) for r in rows]
    by = {name: [i for i, _ in rows] for name, rows in kept.items()}
    odd = [r[0] for r in odd_rows]
    assert not {1, 2, 6, 7} & set(by["language_id"])  # no text, or no letter
    assert sorted(by["line_dedup"], key=repr) == sorted([r["doc_id"] for r in docs.collect()], key=repr)
    assert by["near_dedup"].count(4) == 1 and 5 not in by["near_dedup"] and None in by["near_dedup"]  # 4 twice and 5 are one text
    assert by["near_dedup"].count(1) == 1 and not {2, 6} & set(by["near_dedup"])  # null, empty and blank texts are copies
    assert set(odd) <= set(by["decontamination"]) and by["decontamination"].count(4) == 2
    assert by["mixing"].count(4) in (0, 2)  # repeated rows are decided alike
