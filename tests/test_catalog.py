"""Every registered query that has SQL gives the rows of that SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from skysieve.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(frame, columns):
    def cell(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return "~"
        v = v.tolist() if hasattr(v, "tolist") else v
        return int(v) if isinstance(v, float) and math.isfinite(v) and v == int(v) else v

    return sorted(repr(tuple(map(cell, r))) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


def test_entry_points_import():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and set(catalog.queries()) <= set(known)


def test_uncovered_ids_reads_every_order(spark, tmp_path):
    """A customer whose only order isn't a twentieth one is covered."""
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(7, 1)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert [r["id"] for r in catalog.queries()["uncovered_ids"](spark, str(tmp_path)).collect()] == [2]
