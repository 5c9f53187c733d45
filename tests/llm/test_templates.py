from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skysieve.llm import templates

ITEM = "Maria buys 12 apples and 7 pears for 3 euros, then Maria sells 5 apples to her friend Tom and keeps the rest of the fruit."


@given(st.lists(st.text(alphabet="aB 1.%\nkgTom,é'", max_size=60), max_size=6))
@settings(max_examples=100, deadline=None)
def test_coder_equals_template(texts):
    codes, owner = templates.Coder().encode(texts)
    for k, t in enumerate(texts):
        assert codes[owner == k].tolist() == templates._codes(templates.template(t)[0]).tolist()


def test_template_slots():
    parts, values = templates.template("He met Anna. Anna ran 5 km in twenty minutes.")
    assert parts == ["he", "met", "<name>", "anna", "ran", "<num>", "<unit>", "in", "<num>", "<unit>"]
    assert values[2] == "anna" and values[5] == "5"


def _filler(rng, n=80):
    return " ".join(rng.choice([f"filler{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], n))


def test_finds_leaks(spark, documents):
    rng = np.random.default_rng(0)
    again = ITEM.replace("Maria", "Petra").replace("12", "40").replace("7 pears", "9 pears").replace("3 euros", "8 euros").replace("5 apples", "6 apples").replace("Tom", "Max")
    mixed = ITEM.replace("then Maria", "then Laura").replace("Tom", "Rob")
    rows = [(1, _filler(rng) + " " + ITEM + " " + _filler(rng)), (2, _filler(rng) + ". " + again + " " + _filler(rng)), (3, _filler(rng)), (4, None), (5, ""), (6, _filler(rng) + " " + " ".join(ITEM.split()[:6]) + " " + _filler(rng)), (7, "short item of six plain words"), (8, (_filler(rng, 20_000) + " " + ITEM)), (None, ITEM), (9, mixed)]
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "Short item of six plain words."), (13, "...")], "item_id long, text string")
    found = {(r["id"], r["item"]): r["slots_changed"] for r in templates.matches(documents(rows), bench).collect()}
    assert found.keys() >= {(1, 10), (2, 10), (7, 12), (8, 10)} and {k[0] for k in found} <= {1, 2, 7, 8, 9}
    assert found[(1, 10)] is False and found[(2, 10)] is True
    docs = documents(rows).withColumns({"id": F.lit(0), "h": F.lit(1), "item": F.lit(2)})
    kept = templates.clean(docs, bench)
    assert kept.columns == docs.columns and {3, 4, 5, 6, None} <= {r["doc_id"] for r in kept.collect()}


def test_inconsistent_slots_are_left_alone(spark, documents):
    item = "a box with 4 red balls costs 4 coins and a bag with 4 blue balls costs 4 coins in total"
    other = "a box with 1 red balls costs 2 coins and a bag with 3 blue balls costs 5 coins in total"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert templates.matches(documents([(1, other)]), bench).count() == 0
    assert templates.matches(documents([(1, item.replace("4", "9"))]), bench).count() == 1


def test_partial_and_edited_items(spark, documents):
    rng = np.random.default_rng(1)
    long, short = _filler(rng, 59), _filler(rng, 35)
    edited = short.split()
    edited[11], edited[23] = "other", "word"
    rows = [(1, _filler(rng) + " " + " ".join(long.split()[20:48]) + " " + _filler(rng)), (2, " ".join(edited)), (3, " ".join(long.split()[20:30]) + " " + _filler(rng))]
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    got = templates.matches(documents(rows), bench)
    assert got.columns == ["id", "item", "n_windows", "n_matched", "n_slots", "slots_changed", "coverage"]
    assert {(r["id"], r["item"]): r["n_matched"] for r in got.collect()} == {(1, 1): 21, (2, 2): 12}
    assert {r["doc_id"] for r in templates.clean(documents(rows), bench).collect()} == {3}


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert templates.matches(documents([]), bench).count() == 0
    assert templates.matches(documents([(1, ITEM)]), bench.limit(0)).count() == 0


def test_query_finds_every_verbatim_item(spark):
    import pandas as pd

    d = "/root/testdata/sf0.01"
    docs, bench = pd.read_parquet(f"{d}/documents.parquet"), pd.read_parquet(f"{d}/benchmark.parquet")
    want = {(i, j) for j, t in zip(bench.item_id, bench.text) for i, x in zip(docs.doc_id, docs.text) if t in x}
    got = {(r["doc_id"], r["item_id"]) for r in templates.op2(spark, d).collect()}
    assert want and want == got


def brute_matches(docs, items):
    """(id, item): (n_windows, n_matched, n_slots, slots_changed) by comparing every window of template words."""
    texts, found = {}, {}
    for i, text in docs:
        if i is not None:
            texts.setdefault(i, []).append(templates.template(text))
    for item, text in items:
        mine, parts = templates.item_windows(text), templates.template(text)[0]
        for i, rows in texts.items():
            by_shift = {}
            for words, values in rows:
                for _, w, pos, slots, n in mine:
                    want = parts[pos : pos + w]
                    for at in range(len(words) - w + 1):
                        if words[at : at + w] == want:
                            filled = [v for v in values[at : at + w] if v]
                            if len(filled) == len(slots):
                                by_shift.setdefault(at - pos, []).append((pos, w, tuple(zip(slots, filled)), n))
            good = []
            for hits in by_shift.values():
                pairs = {p for h in hits for p in h[2]}
                if len(pairs) * templates.CONSISTENT <= len({a for a, _ in pairs}):
                    covered = sorted({x for h in hits for x in range(h[0], h[0] + h[1])})
                    run = best = 0
                    for a, b in zip([None, *covered], covered):
                        run = run + 1 if a is not None and b == a + 1 else 1
                        best = max(best, run)
                    good.append(({h[0] for h in hits}, set(covered), best, pairs, hits[0][3]))
            if not good:
                continue
            every = set().union(*[g[3] for g in good])
            agree = len(every) * templates.CONSISTENT <= len({a for a, _ in every})
            matched, covered = (len(set().union(*[g[k] for g in good])) if agree else max(len(g[k]) for g in good) for k in (0, 1))
            words = good[0][4]
            absolute = words and (max(g[2] for g in good) >= templates.RUN or covered >= templates.RUN and covered >= templates.COVERAGE * words)
            if matched / len(mine) >= templates.COVERAGE or absolute:
                found[i, item] = (len(mine), matched, max(len(g[3]) for g in good), all(any(a != b for a, b in g[3]) for g in good))
    return found


def test_query_against_every_window(spark):
    d = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_matched"], r["n_slots"], r["slots_changed"]) for r in templates.op2(spark, d).collect()}
    assert got and got == brute_matches(docs, items)


def test_repeats_ties_and_contradictions(spark, documents):
    rng = np.random.default_rng(5)
    filler = _filler(rng)
    parts = ITEM.split()
    halves = " ".join(parts[:13]) + " " + filler + " " + " ".join(parts[13:]).replace("5", "77").replace("Tom", "Kim")
    rows = [(1, ITEM), (1, ITEM), (2, filler), (2, ITEM), (3, halves), (4, ITEM + " " + filler + " " + ITEM.replace("12", "99").replace("7", "55")), (5, " ".join(parts[:14])), (None, ITEM)]
    bench = [(10, ITEM), (11, ITEM), (12, "no " * 30)]
    got = {(r["id"], r["item"]): (r["n_windows"], r["n_matched"], r["n_slots"], r["slots_changed"]) for r in templates.matches(documents(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == brute_matches(rows, bench) and {(1, 10), (1, 11), (2, 10), (4, 11)} <= got.keys()
