from __future__ import annotations

import numpy as np

from skysieve.llm import copies


def brute_keep(rows, width=5, similarity=0.8):
    sets = [set(copies.shingle_set((t or "").encode(), width).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i] | sets[j])) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d for i, (d, _) in enumerate(rows) if low[find(i)] == d}


def test_one_of_each_group_stays(spark, documents):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(500)]
    rows = [(900, None), (901, ""), (902, "x y"), (903, "X  y"), (904, "same text here"), (905, "same text here"), (906, "long " * 20_000)]
    passage = " ".join(rng.choice(words, 60))
    for k in range(40):
        base = list(rng.choice(words, 120))
        rows.append((10 * k, " ".join(base)))
        for v in range(1, 4):
            base[rng.integers(0, 120)] = "edited"
            rows.append((10 * k + v, " ".join(base)))
        rows.append((10 * k + 7, passage + " " + " ".join(rng.choice(words, 60))))
    got = {r["doc_id"] for r in copies.keep_one(documents(rows)).select("doc_id").collect()}
    assert got == brute_keep(rows)


def test_large_group_of_variants(spark, documents):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(500)]
    base, rows = list(rng.choice(words, 200)), []
    for k in range(150):
        mine = list(base)
        for at in rng.integers(0, 200, rng.integers(0, 3)):
            mine[at] = f"v{k}"
        rows.append((k, " ".join(mine)))
    got = {r["doc_id"] for r in copies.keep_one(documents(rows)).select("doc_id").collect()}
    assert got == brute_keep(rows)


def test_variants_far_from_the_ends_of_a_key(spark, documents, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(2_000)]
    base, rows = list(rng.choice(words, 200)), []
    for k in range(640):
        mine = list(base)
        for at in rng.choice(200, 3, replace=False):
            mine[at] = f"v{rng.integers(1 << 40)}"
        rows.append((k, " ".join(mine)))
    want = brute_keep(rows)
    assert {r["doc_id"] for r in copies.keep_one(documents(rows)).select("doc_id").collect()} == want
    monkeypatch.setattr(copies, "BLOCK", 9_000)  # several blocks a key
    assert {r["doc_id"] for r in copies.keep_one(documents(rows)).select("doc_id").collect()} == want


def test_short_texts_that_differ_by_an_end_word(spark, documents):
    rng = np.random.default_rng(8)
    rows = []
    for size in range(8, 15):
        for _ in range(6):
            text = [f"u{rng.integers(1 << 40)}" for _ in range(size)]
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(text[:-1] if rng.integers(2) else text[1:]))]
    assert {r["doc_id"] for r in copies.keep_one(documents(rows)).select("doc_id").collect()} == brute_keep(rows)


def test_prefixes_meet_for_every_short_pair():
    rng = np.random.default_rng(9)
    for n in range(1, copies.SHORT):
        for m in range(n, int(n / 0.8 + 1e-9) + 1):
            for both in range(n + 1):
                if both >= 0.8 * (n + m - both) - 1e-9:
                    x = np.unique(rng.integers(0, 1 << 63, n + m, np.uint64))
                    rng.shuffle(x)
                    a, b = np.sort(x[:n]), np.sort(np.concatenate([x[:both], x[n : n + m - both]]))
                    assert set(copies.candidate_keys(a)) & set(copies.candidate_keys(b))


def test_null_ids_and_extra_columns(spark, documents):
    from pyspark.sql import functions as F

    docs = documents([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]).withColumns({"id": F.lit("x"), "root": F.lit(1), "fp": F.lit(2), "key": F.lit(3)})
    kept = copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]
    assert copies.keep_one(documents([])).count() == 0


def test_repeated_ids(spark, documents):
    a, b = "one text of seven words in all", "quite another text that has no copy"
    rows = [(3, a), (5, a), (5, b), (7, "a row that stands here twice"), (7, "a row that stands here twice"), (8, None), (8, ""), (None, a), (None, a)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in copies.keep_one(documents(rows)).collect())
    assert kept == [(0, a), (0, a), (3, a), (5, b), (7, "a row that stands here twice"), (8, "")]


def test_ids_of_text(spark, documents):
    from pyspark.sql import functions as F

    a, b = "one text of seven words in all", "quite another text that has no copy"
    docs = documents([(1, a), (2, a), (3, b)]).withColumn("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    assert sorted(r["doc_id"] for r in copies.keep_one(docs).collect()) == ["d/1", "d/3"]
