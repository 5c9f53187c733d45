from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.llm import urls


def test_boundaries_and_weights():
    v = urls.Vocabulary(("porn",), ("free", "win", "sex"), 2)
    assert v.rejects("http://x/PORN-now") and not v.rejects("http://x/popcorn") and not v.rejects("http://essex/")
    assert not v.rejects("http://x/free/free") and v.rejects("http://x/free/win") and not v.rejects(None)
    assert not urls.Vocabulary((), ()).rejects("http://free/win")


def test_rules(spark):
    rows = [(1, "https://www.Example.com/en/7x"), (2, "http://example.com/en/8"), (3, "http://notexample.com/en/7"), (4, "http://a.net/de/1"), (5, "http://example.net/de/81?q"), (6, "ftp://b.org/es/#f"), (7, "http://b.org/fr"), (8, "no scheme com/en/"), (9, None), (10, "http://com"), (11, "http://x.com/EN/"), (12, "http://a://b/c"), (12, "http://a://b/c"), (13, "http://q.com?x=/en/"), (14, "http://b.info/xxx")]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumns({"id": F.lit(1), "host": F.lit("h"), "rule": F.lit("r")})
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(table).collect()}
    assert got[1] == ("www.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block") and got[3][2:] == ("com/en/", "block")
    assert got[4][2:] == ("net/de/", "allow") and got[5][1:] == ("/de/81", "example.net/de/8", "block")
    assert got[6][2:] == ("org/es/", "block") and got[7][2:] == (None, "allow")
    assert got[8][:3] == got[9][:3] == ("", "", None) and got[10] == ("com", "", None, "allow")
    assert got[11][2] is None and got[12][:2] == ("a:", "//b/c") and got[13][:2] == ("q.com", "") and got[14][3] == "block"
    assert urls.judge(table.limit(0)).count() == 0


def test_terms_from_a_table(spark):
    terms = spark.createDataFrame([("Bad", 5), ("meh", 2), ("meh", 3), ("so", 2), ("-", 9), (None, 9), ("gone", 0)], "term string, weight int")
    v = urls.Vocabulary.of(terms, 5)
    assert set(v.strict) == {"bad"} and v.weights() == {"meh": 3, "so": 2}
    assert v.rejects("http://x/bad") and v.rejects("http://x/meh/so") and not v.rejects("http://x/meh/meh") and not v.rejects("http://x/gone-")


def test_long_urls_and_null_ids(spark):
    rows = [(None, "http://a/" + "x" * 300_000 + "/porn"), (None, None), (1, "http://" + "a." * 50_000 + "com/en/" + "free-" * 1_000)]
    got = [(r["id"], len(r["host"]), r["rule"], r["verdict"], r["soft_terms"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    assert got == [(None, 1, None, "block", 0), (None, 0, None, "allow", 0), (1, 100_003, "com/en/", "block", 1)]


def test_hits_against_regular_expressions():
    import random
    import re

    rng, v = random.Random(1), urls.Vocabulary()
    bits = [*urls.STRICT[:3], *urls.SOFT[:5], "/", "-", ".", "a", "9", "é", "Sex"]
    for _ in range(400):
        url = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        inside = lambda t: re.search(rf"(?<![^\W_]){t}(?![^\W_])", url.lower()) is not None
        assert v.rejects(url) == (any(map(inside, urls.STRICT)) or sum(map(inside, urls.SOFT)) >= urls.SOFT_HITS)
