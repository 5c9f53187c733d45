"""Bitmap indexes of flag tables against sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skysieve.operators import flags


def test_index_against_sets(spark):
    rng = np.random.default_rng(4)
    pick = lambda n: [int(x) for x in rng.choice([*range(-3, 60), 32_767, 32_768, 32_769, 65_536, 65_537, 2**40, 2**40 + 1], n)]
    a = [(f"t{k % 5}", n) for k, n in enumerate(pick(60))] + [(None, 7), ("t1", None)]
    b = [(n,) for n in pick(25)] + [(None,)]
    c = [("t9", 1), ("t9", 1), ("t0", 32_768)]
    rows = [(k, t, n) for k, (t, n) in enumerate(zip(rng.choice(["t0", "t1", "t2", "t3", "t4", "t7"], 400).tolist(), pick(400)))] + [(900, None, 5), (901, "t1", None), (902, None, None)]
    tables = {"a": spark.createDataFrame(a * 3, "tile_id string, NUMBER long"), "b": spark.createDataFrame(b, "NUMBER long"), "c": spark.createDataFrame(c, "tile_id string, NUMBER long")}
    index = flags.flag_index(tables)
    assert index.groupBy("tile_id", "bucket").count().where("count > 1").isEmpty()
    df = spark.createDataFrame(rows, "id int, tile_id string, NUMBER long").withColumn("gates", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in flags.indexed_flags(df, index, ["a", "b", "c"]).collect()}
    want = {k: (n is not None and t is not None and (t, n) in a, n is not None and (n,) in b, n is not None and (t, n) in c) for k, t, n in rows}
    assert got == want and all(any(w[k] for w in want.values()) for k in range(3))
    kept, tallies = flags.indexed_survivors(df, index, ["a", "b", "c"])
    assert kept.columns == df.columns and sorted(r["id"] for r in kept.collect()) == sorted(k for k, w in want.items() if not any(w))
    assert tuple(tallies.first()) == (len(rows), *[sum(w[k] for w in want.values()) for k in range(3)], sum(not any(w) for w in want.values()))
    empty = flags.flag_index({"a": tables["a"].limit(0)})
    assert flags.indexed_flags(df, empty, ["a"]).where("a").isEmpty()
