from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from skysieve.llm import infill

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def slow(doc, text, seed=42, rate=50, spm=80):
    text, word = text or "", TOKEN.findall(text or "")
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(word) + 1), h[1] % (len(word) + 1)))
    p, m, s = "".join(word[:a]), "".join(word[a:b]), "".join(word[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(word), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(word), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(word), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(odd_rows):
    rng = np.random.default_rng(3)
    rows = [(r[0], r[1]) for r in odd_rows]
    rows += [(100 + k, "".join(rng.choice(list("ab \t\n\x0b\x0c\ré日<PSM>\x1c  "), int(rng.integers(0, 50))))) for k in range(600)]
    return rows + [(50, "a <P> b"), (51, "x<S>"), (52, "<M"), (53, "<P"), (54, "P> <S <M " * 50), (55, "lone   line"), (56, "x" * 200_000), (57, " " * 50_000 + "é")]


def test_against_regular_expressions(spark, odd_rows):
    rows = rows_of(odd_rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for rate, spm in ((50, 80), (100, 0), (100, 100), (0, 50)):
        got = infill.infilled(docs, rate=rate, spm=spm).select("row.doc_id", "row.text", "fim.*").collect()
        assert len(got) == len(rows)
        for r in got:
            want = slow(r["doc_id"], r["text"], rate=rate, spm=spm)
            assert tuple(r)[2:7] == want, r
            assert (r["output_sha256"], r["restored_sha256"]) == (sha(want[4]), sha(r["text"] or ""))
    assert {slow(d, t)[1] for d, t in rows} == {"plain", "psm", "spm"}


def test_texts_come_back(spark, odd_rows):
    docs = spark.createDataFrame(rows_of(odd_rows), "doc_id long, text string")
    made = infill.infilled(docs, rate=100).select("row.doc_id", F.col("row.text").alias("old"), F.col("fim.output").alias("text"), "fim.form")
    back = infill.restored(made)
    assert back.where("text <> coalesce(old, '')").isEmpty() and made.where("form <> 'plain'").count() > 100


def test_other_columns_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1, "x"), (2, None, 2, "y")], "doc_id long, text string, i long, output string").withColumn("batch", F.array(F.lit(1))).withColumn("a.b", F.lit(0))
    got = infill.fill_in_middle(docs, rate=100)
    assert got.columns == docs.columns
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["text"] == slow(1, "a b c d", rate=100)[4] and by[2]["text"] is None and by[2]["output"] == "y" and by[1]["batch"] == [1]
    assert infill.fill_in_middle(docs.limit(0)).count() == 0
    assert infill.infilled(docs, output=False).where("fim.output IS NOT NULL").isEmpty()
