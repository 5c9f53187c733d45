from __future__ import annotations

import re
import signal

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skysieve.llm import simhash


def slow_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="abAB \t\n\x0bé.", max_size=80))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode(), 3)) == slow_fingerprint(text)


def test_fingerprint_of_many_shingles():
    text = " ".join(f"w{k * k % 977}" for k in range(9_000))
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode(), 3)) == slow_fingerprint(text)


def brute_components(fps, ids, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(fps))]


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_see_every_pair(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    fps = np.unique(np.concatenate([base, *[b ^ (np.uint64(1) << rng.integers(0, 64, 6, np.uint64)) for b in base], rng.integers(0, 1 << 63, 400, np.uint64)]))
    tree = simhash.VantageTree(fps[::3], 4)
    rows, shards = tree.shards(fps, 2)
    own_rows, own_shards = tree.shards(fps, 0)
    assert sorted(own_rows.tolist()) == list(range(len(fps)))
    home = dict(zip(own_rows.tolist(), own_shards.tolist()))
    visits = set(zip(rows.tolist(), shards.tolist()))
    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps ^ fps[i]) <= 2)[0].tolist():
            assert (j, home[i]) in visits
    simhash_block, simhash.BLOCK = simhash.BLOCK, 512
    try:
        forest = simhash.shard_links(fps, np.ones(len(fps), bool), 2)
    finally:
        simhash.BLOCK = simhash_block
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in forest:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = brute_components(fps, list(range(len(fps))), 2)
    assert len({find(i) for i in range(len(fps))}) == len(set(want))


def forest_groups(n, forest):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in forest:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def limited(seconds):
    """Raises in this thread after so many seconds."""

    def stop(*_):
        raise TimeoutError(f"over {seconds} s")

    signal.signal(signal.SIGALRM, stop)
    signal.alarm(seconds)


def test_chains_with_the_first_row_end():
    """Union-find ends, and groups are right, where chains of near copies hold row 0."""
    rng = np.random.default_rng(0)
    cases = [np.array([0x100000000AA, 0x10000000011, 0x10000000082, 0x10000000003, 0x10000000000, 0x10000000042], np.uint64)]
    for _ in range(1_000):
        walk = [int(rng.integers(0, 1 << 63))]
        for _ in range(int(rng.integers(2, 14))):
            bits = rng.integers(0, 10, 2)
            walk.append(walk[int(rng.integers(0, len(walk)))] ^ 1 << int(bits[0]) ^ 1 << int(bits[1]))
        cases.append(rng.permutation(np.unique(np.array(walk, np.uint64))))
    limited(120)
    try:
        for fps in cases:
            owned = rng.random(len(fps)) < 0.8
            owned[rng.integers(0, len(fps))] = True
            whole = forest_groups(len(fps), simhash.shard_links(fps, np.ones(len(fps), bool), 2))
            assert whole == brute_components(fps.tolist(), list(range(len(fps))), 2)
            forest = simhash.shard_links(fps, owned, 2)
            links = [(i, j) for i in np.nonzero(owned)[0].tolist() for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2]
            assert forest_groups(len(fps), forest) == forest_groups(len(fps), links)
    finally:
        signal.alarm(0)


def test_chained_fingerprints_on_tables(spark):
    chain = [0x100000000AA, 0x10000000011, 0x10000000082, 0x10000000003, 0x10000000000, 0x10000000042]
    rows = chain + [x ^ 0x7FFF << 40 for x in chain]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in rows], "fp long"), 2)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    want = brute_components(rows, rows, 2)
    assert [found.get(x, x) for x in rows] == want


def test_near_duplicates(spark, documents, odd_rows):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, 900)) for _ in range(12)]
    rows = [r for r in odd_rows if r[0] is not None]
    for k, t in enumerate(texts):
        parts = t.split()
        for v in range(4):
            parts[10 + v * 7] = "changed"
            rows.append((100 + 10 * k + v, " ".join(parts)))
    found = {(r["id"], r["fp"]): r["component"] for r in simhash.near_duplicates(documents(rows)).collect()}
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = brute_components(fps, [r[0] for r in rows], 2)
    for r, f, c in zip(rows, fps, want):
        assert found[(r[0], f - (1 << 64) if f >> 63 else f)] == c
    assert len(set(want)) < len(rows)


def test_empty_table(spark, documents):
    assert simhash.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components_chain(spark, monkeypatch, local):
    monkeypatch.setattr(simhash, "LOCAL_LINKS", local)
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(k, 200) for k in range(201, 260)] + [(5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert all(found[k] == 0 for k in range(1, 61)) and all(found[k] == 200 for k in range(201, 260)) and 200 not in found
    assert simhash.components(links.limit(0)).count() == 0


def test_null_ids_and_other_columns(spark, documents):
    from pyspark.sql import functions as F

    docs = documents([(None, "a b c d e"), (3, "a b c d e"), (7, "a b c d e"), (None, "zz yy xx ww vv")]).withColumns({"id": F.lit("x"), "fp": F.lit(1), "component": F.lit(2), "root": F.lit(3)})
    found = sorted(((r["id"], r["component"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert found == [(3, 3), (7, 3), (None, 3), (None, None)]
