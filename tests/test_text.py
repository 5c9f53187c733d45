from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from skysieve.functions import text


def values(spark, column, items, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").orderBy("i").select(column).collect()]


def test_epochs(spark):
    items = ["1953-04-12T06:07:08", "1953-04-12 06:07:08Z", "1953-04-12T06:77:90", "1953-04-12T23:59:60", "1953-04-12T02:00:00+03:00", "1953-04-12T06:07:08.25", "1953-04-12", "1953-13-40T00:00:00", "junk", "", None]
    got = values(spark, text.epoch_iso("x"), items)
    assert got == ["1953-04-12T06:07:08+00:00", "1953-04-12T06:07:08+00:00", "1953-04-12T07:18:30+00:00", "1953-04-12T00:00:00+00:00", "1953-04-11T23:00:00+00:00", "1953-04-12T06:07:08.250000+00:00", "1953-04-12T00:00:00+00:00", None, None, None, None]
    assert values(spark, text.epoch_iso("x", True), ["1953-04-12T23:59:60"]) == ["1953-04-13T00:00:00+00:00"]
    assert values(spark, text.mjd(text.epoch_timestamp("x")), ["1858-11-17T00:00:00", "2000-01-01T12:00:00"]) == [0.0, 51544.5]
    assert values(spark, text.jd(text.epoch_timestamp("x")), ["2000-01-01T12:00:00"]) == [2451545.0]


def test_ids(spark):
    assert values(spark, text.canonical_id("x"), ["12", "1.2E+3", "5.0", "x", None, "1e60"]) == ["12", "1200", "5", None, None, None]
    want = str(int.from_bytes(hashlib.sha1(b"t:7").digest()[:8], "big"))
    assert values(spark, text.stable_row_id(F.lit("t"), "x"), [7], "int") == [want]
    assert values(spark, text.tile_of("x"), ["tile-1:9", "plain"]) == ["tile-1", "plain"]
    assert values(spark, text.object_number("x"), ["12.0", "7", "a", None]) == [12, 7, None, None]
    assert values(spark, text.moon_code("x"), ["0", "00", "1x1", "7"]) == ["00", "00", "11", "07"]
    assert values(spark, text.truthy("x"), ["True", "0", " yes", None, "no"]) == [True, False, True, False, False]


def test_tile_names(spark):
    ra, dec = text.tile_centre("x")
    assert values(spark, ra, ["tile-RA10.500-DEC-5.250", "tile-RA_10.5-DEC_+5", "none"]) == [10.5, 10.5, None]
    assert values(spark, dec, ["tile-RA10.500-DEC-5.250", "tile-RA_10.5-DEC_+5", "none"]) == [-5.25, 5.0, None]
    assert values(spark, text.tile_name(F.lit(10.5), F.lit(-5.25)), ["x"]) == ["tile-RA10.500-DEC-5.250"]


def test_sexagesimal(spark):
    assert values(spark, text.sexagesimal("x", True), ["01 30 00", "1:30", "01h30m00s", None]) == [22.5, 22.5, 22.5, None]
    assert values(spark, text.sexagesimal("x", False), ["-00 30 00", "+10:15:36"]) == [-0.5, pytest.approx(10.26)]


def test_magnitudes(spark):
    got = values(spark, text.valid_magnitude("x", faintest=16.0), [12.0, -999.0, -1.0, 16.0, 16.1, float("nan"), None, 0.0], "double")
    assert got == [True, False, False, True, False, False, False, True]
