from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skysieve.llm import tokencount


@pytest.fixture(scope="module")
def counter():
    return tokencount.load()


def test_edits_equal_a_fresh_count(counter):
    rng, bits = random.Random(3), ["", " ", "'", "'re", "ll", "\n", "\n\n ", "abc", " Day's", "123", "!!", "é", "  ", "x" * 200, " a b c d e" * 60]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 20, 300])))
        tree = tokencount.SegmentTree(text, counter)
        assert tree.total == counter.total(text)
        for _ in range(6):
            a = rng.randint(0, len(text) + 2)
            b, new = a + rng.choice([0, 0, 1, 2, 5, 30, 400]), rng.choice(bits)
            tree.edit(a, b, new)
            text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
            assert tree.text == text and tree.total == counter.total(text)


def test_counts_equal_the_tokenizer(counter):
    counter._ready()
    for text in ("Hello world, it's 5 o'clock!\n\n  Yes?", "ñandú über straße", "a" * 3_000):
        assert counter.total(text) == len(counter._encoding.encode_ordinary(text))


def test_only_the_touched_region_is_encoded(counter):
    tree = tokencount.SegmentTree("one two three four " * 2_000, counter)
    tree.edit(20_000, 20_003, "seven")
    assert tree.fresh < 12


def test_stored_trees_are_edited_again_and_again(spark, documents, counter):
    rng, bits = random.Random(5), [" word", "ing", "'ll", "\n\n", " 12", "é!", " a b c" * 40, ""]
    texts = {k: "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 400, 2_000]))) for k in range(24)}
    trees = tokencount.build(documents([*texts.items()]), counter)
    for round_ in range(3):
        rows = []
        for k, text in texts.items():
            for seq in range(rng.randint(0, 3)):
                a = rng.randint(0, len(text) + 1)
                b, new = a + rng.choice([0, 3, 60]), rng.choice(bits)
                rows.append((k, seq, a, b, new))
                texts[k] = text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
        edits = spark.createDataFrame(rows, "id long, seq int, start int, end int, replacement string")
        trees = tokencount.stored(tokencount.apply_edits(tokencount.with_edits(trees, edits, "id"), counter), "trees")
        for r in trees.collect():
            assert (r["text"], r["n_tokens"]) == (texts[r["id"]], counter.total(texts[r["id"]])) and sum(r["lengths"]) == len(r["text"])
            if not any(x[0] == r["id"] for x in rows):
                assert r["n_reencoded"] == 0
    # a long document: an edit encodes a few pre-tokens of many
    long = tokencount.build(documents([(1, "one two three four " * 20_000)]), counter)
    edits = spark.createDataFrame([(1, 1, 200_000, 200_003, "seven")], "id long, seq int, start int, end int, replacement string")
    after = tokencount.apply_edits(tokencount.with_edits(long, edits, "id"), counter).first()
    assert 0 < after["n_reencoded"] < 12 and after["n_pretokens"] > 70_000


def test_query_shape(spark, documents, odd_rows, counter):
    docs = documents(odd_rows)
    edits = spark.createDataFrame([(4, 2, 0, 4, "other"), (4, 1, 0, 0, "x "), (3, 1, 5, 9, None), (77, 1, 0, 0, "lost"), (2, 1, 9, 12, "new text")], "doc_id long, seq int, start int, end int, replacement string")
    found = tokencount.count_edits(tokencount.with_edits(docs, edits), counter).collect()
    assert len(found) == len(odd_rows)
    by = {r["id"]: r for r in found}
    assert by[1]["n_tokens"] == by[1]["n_tokens_after"] == 0
    assert by[2]["n_tokens_after"] == counter.total("new text")
    once = "x same text here"
    assert by[4]["n_tokens_after"] == counter.total("other" + once[4:])
    assert by[5]["n_tokens"] == by[5]["n_tokens_after"]
    whole = tokencount.count_edits(docs.withColumn("edits", tokencount.standard_edits("text", "doc_id")).withColumns({"id": F.lit(1)}), counter)
    assert whole.count() == len(odd_rows)
    assert tokencount.count_edits(documents([]).withColumn("edits", tokencount.standard_edits("text", "doc_id")), counter).count() == 0


def test_standard_edits_against_fresh_counts(spark, documents, counter):
    rows = [(k, "Some words, it's line\n" * k) for k in range(30)]
    marked = documents(rows).withColumn("edits", tokencount.standard_edits("text", "doc_id"))
    found = {r["id"]: r["n_tokens_after"] for r in tokencount.count_edits(marked, counter).collect()}
    for r in marked.collect():
        text = r["text"]
        for e in r["edits"]:
            a, b = min(e["start"], len(text)), min(max(e["end"], e["start"]), len(text))
            text = text[:a] + (e["replacement"] or "") + text[b:]
        assert found[r["doc_id"]] == counter.total(text)
