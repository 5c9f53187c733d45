from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skysieve.llm import substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, width):
    """(id, text) -> (words, removed, remaining text) by a table of every window's smallest id."""
    words = [WORD.findall(t or "") for _, t in rows]
    rank = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for r, w in zip(rank, words):
        for k in range(len(w) - width + 1):
            s = tuple(w[k : k + width])
            first[s] = min(first.get(s, float("inf")), r)
    out = []
    for r, w in zip(rank, words):
        gone = {p for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < r for p in range(k, k + width)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def run(spark, rows, width):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = substrings.strip_repeats(docs, width=width).select("row.doc_id", "row.text", "kept.*").collect()
    return sorted((repr(r[0]), repr(r[1]), r[2], r[3], r[4]) for r in found)


def expected(rows, width):
    return sorted((repr(d), repr(t), *b) for (d, t), b in zip(rows, brute(rows, width)))


def corpus(seed, n=60, alphabet=6):
    """Documents of passages, edits and periods over few words, so that windows repeat in part everywhere."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(alphabet)]
    passages = [list(rng.choice(words, int(rng.integers(4, 40)))) for _ in range(8)]
    rows = []
    for d in rng.permutation(n).tolist():
        w = []
        for _ in range(int(rng.integers(0, 6))):
            p = list(passages[int(rng.integers(0, 8))])
            if rng.random() < 0.5:
                p[int(rng.integers(0, len(p)))] = "edit" + str(rng.integers(0, 3))
            a = int(rng.integers(0, len(p)))
            w += p[a:] + list(rng.choice(words, int(rng.integers(0, 5))))
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "width"), [(1, 13), (2, 6), (3, 3)])
def test_against_all_windows(spark, seed, width):
    rows = corpus(seed)
    assert run(spark, rows, width) == expected(rows, width)
    assert any(r[3] for r in expected(rows, width))


def test_small_blocks_and_keys_dealt_apart(spark, monkeypatch):
    """Blocks of one piece, and keys with over one piece dealt by windows, give the same rows."""
    rows = corpus(4, 80)
    monkeypatch.setattr(substrings, "BLOCK", 1)
    want = expected(rows, 6)
    assert run(spark, rows, 6) == want
    monkeypatch.setattr(substrings, "MOST", 1)
    assert run(spark, rows, 6) == want


def test_parse_takes_windows_over_factor_boundaries():
    """The factor from 0 ends at 6; the window 4..8 repeats from elsewhere and reaches over that end."""
    reference = [np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5, 6, 90], [91, 5, 6, 7, 8, 92])]
    piece = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9], np.uint64)
    block = substrings.Reference([*reference, piece], np.array([1, 2, 3]), 4)
    assert block.hits().tolist() == [2] and block.parse(2) == [(0, 6), (4, 4)]
    assert substrings.Reference([piece, piece[:5]], np.array([7, 7]), 4).hits().tolist() == []


def test_cases(spark, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    long = " ".join(f"a{k}" for k in range(40))
    rows += [(20, long), (21, "x " + long + "\ty"), (21, "x " + long + "\ty"), (21, "other " + long), (None, long), (22, long.replace("a20", "b")), (23, " " + long + " z"), (24, " ".join(["same"] * 500)), (25, " ".join(["same"] * 30)), (19, "é ü " * 20), (18, "é ü " * 20)]
    assert run(spark, rows, 13) == expected(rows, 13)


def test_clashing_columns_and_an_empty_table(spark):
    text = " ".join(f"a{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, "k", 5), (2, text, "k", 6)], "doc_id long, text string, key string, ord int").withColumn("row", F.lit(1)).withColumn("spans", F.lit("s")).withColumn("tag.x", F.lit(2))
    got = substrings.dedup_substrings(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {(1, text, "k", 5, 1, "s", 2), (2, "", "k", 6, 1, "s", 2)}
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


def test_codes_of_words():
    """Equal words have equal codes wherever they stand, and others other ones; rows bound words."""
    texts = [b"ab cd\tab", None, b"", b" \n ", b"ab", b"cd ab\x0b", "é ü\x1cx é".encode(), b"x" * 300 + b" " + b"x" * 301, b"aab", b"baa", b"ab"]
    for column in (pa.array(texts, pa.binary()), pa.array([b"zz z", *texts], pa.large_binary())[1:]):
        codes, counts = substrings.codes_of(column)
        words = [substrings.words_of(t) for t in texts]
        assert counts.tolist() == [len(w) for w in words]
        flat = [w for row in words for w in row]
        assert len(set(codes.tolist())) == len(set(flat)) == len({(w, c) for w, c in zip(flat, codes.tolist())})
    assert substrings.codes_of(pa.array([], pa.binary()))[0].size == 0
