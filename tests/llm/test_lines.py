from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skysieve.llm import bloom, lines


def brute(rows, least):
    split = [[(x, x.strip(" \t\n\x0b\x0c\r").translate({k: k + 32 for k in range(65, 91)})) for x in (t or "").split("\n")] for _, t in rows]
    count = Counter(k for doc in split for k in {k for _, k in doc})
    out = []
    for (d, _), doc in zip(rows, split):
        kept = [x for x, k in doc if not (len(k) >= 1 and count[k] >= least)]
        out.append((d, len(doc), len(doc) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@given(st.lists(st.text(alphabet="aAb \t\né", max_size=12), max_size=20))
@settings(max_examples=25, deadline=None)
def test_strip_text_splits_like_str(texts):
    for t in texts:
        n, dropped, kept = lines.strip_text(t.encode(), frozenset())
        assert (n, dropped, kept.decode()) == (len(t.split("\n")), 0, t)


def test_lines(spark, documents, odd_rows, monkeypatch):
    rng = np.random.default_rng(1)
    pool = [f" Line {k} é" if k % 2 else f"line {k} É\t" for k in range(30)]
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + k, "\n".join(rng.choice(pool, rng.integers(1, 9)))) for k in range(60)]
    docs = documents(rows)
    for limit in (lines.BROADCAST_ROWS, 0):
        monkeypatch.setattr(lines, "BROADCAST_ROWS", limit)
        done = lines.strip_lines(docs.select("doc_id", "text"), lines.frequent_lines(docs, least_docs=10))
        got = sorted(((r["row"]["doc_id"], r["stripped"]["n_lines"], r["stripped"]["n_dropped"], hashlib.sha256((r["stripped"]["text"] or "").encode()).hexdigest()) for r in done.collect()), key=str)
        assert got == brute(rows, 10)
        assert any(r[2] for r in got)


def test_dedup_keeps_columns(spark, documents):
    from pyspark.sql import functions as F

    docs = documents([(k, f"shared\nown {k}") for k in range(12)] + [(99, None)]).withColumns({"row": F.lit(1), "stripped": F.lit("s"), "digests": F.lit(2)})
    out = lines.dedup_lines(docs, length_col="n_chars")
    assert out.columns == docs.columns
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert found[3] == ("own 3", 5) and found[99] == (None, 0)


def test_empty_table(spark, documents):
    assert lines.dedup_lines(documents([])).count() == 0


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 5_000, np.uint64)
    parts = [np.concatenate([keys[k::5], keys[:200]]) for k in range(3)]
    filters = []
    for p in parts:
        f = bloom.TwoFilters(1 << 20)
        f.add(np.unique(p))
        filters.append(f)
    once, twice = filters[0].once, filters[0].twice
    for f in filters[1:]:
        twice = twice | f.twice | once & f.once
        once = once | f.once
    assert bloom.seen(twice, 1 << 20, keys[:200]).all()
    assert bloom.seen(twice, 1 << 20, rng.integers(0, 1 << 63, 5_000, np.uint64)).mean() < 0.01
