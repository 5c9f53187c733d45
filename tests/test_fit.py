"""Polynomial fits from sums: against numpy, with outliers, and by consensus."""

from __future__ import annotations

import numpy as np
import pytest

from skysieve.operators import fit

TRUE_RA = np.array([0.4, 0.8, -0.3, 0.5, 0.1, -0.2]) / 3600
TRUE_DEC = np.array([-0.7, 0.2, 0.6, -0.4, 0.3, 0.25]) / 3600


def tile(rng, name, n, noise=0.05, outliers=0.0, ra0=10.0, dec0=20.0):
    x, y = rng.uniform(-0.25, 0.25, (2, n))
    f = np.column_stack([np.ones(n), x, y, x * x, x * y, y * y])
    far = rng.random(n) < outliers
    ox = f @ TRUE_RA + rng.normal(0, noise, n) / 3600 + far * rng.uniform(4, 60, n) / 3600 * rng.choice([-1, 1], n)
    oy = f @ TRUE_DEC + rng.normal(0, noise, n) / 3600 + far * rng.uniform(4, 60, n) / 3600
    return [(name, f"{name}-{k}", float(ra0 + a), float(dec0 + b), ra0, dec0, float(ra0 + a + c), float(dec0 + b + d)) for k, (a, b, c, d) in enumerate(zip(x, y, ox, oy))]


NAMES = "tile_id string, src_id string, ra double, dec double, ra0 double, dec0 double, ra_ref double, dec_ref double"


def plain(rows, how):
    """The same fit with numpy over one tile's rows."""
    v = np.array([r[2:] for r in rows], float)
    x, y, ox, oy = v[:, 0] - v[:, 2], v[:, 1] - v[:, 3], v[:, 4] - v[:, 0], v[:, 5] - v[:, 1]
    f = np.column_stack([np.ones_like(x), x, y] + ([x * x, x * y, y * y] if how.degree > 1 else []))
    use, rounds = np.isfinite(ox) & np.isfinite(oy) & np.isfinite(f).all(1), 0
    for turn in range(how.rounds + 1):
        if use.sum() < how.least_matches:
            return None
        ra, dec = (np.linalg.lstsq(f[use], o[use], rcond=None)[0] for o in (ox, oy))
        if turn == how.rounds:
            break
        res = np.hypot(ox - f @ ra, oy - f @ dec) * 3600
        known = res[np.isfinite(res)]
        mad = np.median(np.abs(known - np.median(known)))
        sigma = 1.4826 * mad if mad > 0 else known.std() if len(known) > 10 else 0.0
        limit = min(max(how.clip_least, how.clip_sigmas * sigma) if sigma > 0 else how.clip_most, how.clip_most)
        kept, rounds = use & (res <= limit), turn + 1
        if kept.sum() == use.sum():
            break
        use = kept
    return ra, dec, rounds, int(use.sum())


@pytest.mark.parametrize("degree", [1, 2])
def test_fits_against_numpy(spark, degree):
    rng = np.random.default_rng(degree)
    tiles = {"clean": tile(rng, "clean", 120), "dirty": tile(rng, "dirty", 300, outliers=0.15), "few": tile(rng, "few", 12), "shrinks": tile(rng, "shrinks", 24, outliers=0.5), "flat": [r[:6] + (r[2], r[3]) for r in tile(rng, "flat", 40)]}
    tiles["gaps"] = tile(rng, "gaps", 60) + [("gaps", "g", float("nan"), 1.0, 10.0, 20.0, 1.0, 1.0), ("gaps", "h", 10.0, 20.0, 10.0, 20.0, float("inf"), 20.0)]
    how = fit.FitConfig(degree=degree)
    df = spark.createDataFrame([r for t in tiles.values() for r in t], NAMES).repartition(4)
    found = {r["tile_id"]: r for r in fit.fits(df, how=how).collect()}
    assert set(found) == set(tiles)
    for name, rows in tiles.items():
        want, got = plain(rows, how), found[name]
        assert got["ok"] == (want is not None), name
        if want is None:
            assert (got["rounds"], got["kept"], got["dropped"]) == (0, 0, len(rows))
            continue
        assert (got["rounds"], got["kept"], got["dropped"]) == (want[2], want[3], len(rows) - want[3]), name
        assert np.allclose(got["coef_ra"], want[0], atol=1e-10) and np.allclose(got["coef_dec"], want[1], atol=1e-10), name
    assert found["clean"]["ok"] and found["dirty"]["dropped"] > 20 and not found["few"]["ok"]


def test_consensus_survives_many_outliers(spark):
    rng = np.random.default_rng(5)
    rows = tile(rng, "a", 400, noise=0.02, outliers=0.4) + tile(rng, "b", 250, noise=0.02, outliers=0.1) + tile(rng, "tiny", 5)
    out = []
    for parts in (1, 7):
        df = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], NAMES).repartition(parts)
        out.append({r["tile_id"]: r for r in fit.consensus(df, "tile_id", "src_id", draws=64, tolerance_arcsec=0.3).collect()})
    one, two = out
    assert set(one) == set(two) == {"a", "b"}
    for name, rows_ in (("a", 400), ("b", 250)):
        assert (one[name]["draw"], one[name]["agree"], one[name]["n"]) == (two[name]["draw"], two[name]["agree"], two[name]["n"])
        assert np.allclose(one[name]["coef_ra"], two[name]["coef_ra"], atol=1e-12)
        assert np.allclose(one[name]["coef_ra"], TRUE_RA, atol=0.2 / 3600) and np.allclose(one[name]["coef_dec"], TRUE_DEC, atol=0.2 / 3600)
        assert 0.5 * rows_ < one[name]["agree"] < 0.95 * rows_


def test_consensus_counts_by_brute_force(spark):
    """The winner's count is that of its model over all rows, and no drawn model has more."""
    rng = np.random.default_rng(8)
    rows = tile(rng, "a", 60, noise=0.2, outliers=0.3)
    df = spark.createDataFrame(rows, NAMES)
    got = fit.consensus(df, "tile_id", "src_id", degree=1, draws=16, tolerance_arcsec=0.4).first()
    v = np.array([r[2:] for r in rows], float)
    x, y, ox, oy = v[:, 0] - v[:, 2], v[:, 1] - v[:, 3], v[:, 4] - v[:, 0], v[:, 5] - v[:, 1]
    f = np.column_stack([np.ones_like(x), x, y])
    ids = [r[1] for r in rows]
    pool = [r["src_id"] for r in df.selectExpr("src_id", "xxhash64(0, src_id) AS h").orderBy("h", "src_id").limit(48).collect()]
    counts = {}
    hashes = {}
    for r in df.selectExpr("src_id", "explode(sequence(0, 15)) AS d").selectExpr("src_id", "d", "xxhash64(0, d, src_id) AS h").collect():
        hashes[(r["d"], r["src_id"])] = r["h"]
    for d in range(16):
        chosen = [ids.index(s) for s in sorted(pool, key=lambda s: (hashes[(d, s)], s))[:3]]
        ra, dec = (np.linalg.solve(f[chosen], o[chosen]) for o in (ox, oy))
        counts[d] = int((np.hypot(ox - f @ ra, oy - f @ dec) * 3600 <= 0.4).sum())
    top = max(counts.values())
    assert got["agree"] == top and got["draw"] == min(d for d, c in counts.items() if c == top)


def test_rounded_coefficients_keep_the_sign_of_zero_as_sql_does(spark):
    import duckdb

    from skysieve.plans import fit_queries

    values = [-4e-6, 4e-6, -0.70000123, 0.80000499999, 0.0]
    frame = spark.createDataFrame([([v / 3600 for v in values], [0.0])], "coef_ra array<double>, coef_dec array<double>")
    (found,) = frame.select(*fit_queries._rounded(frame)).collect()
    expected = duckdb.connect().execute("SELECT [round(v / 3600 * 3600, 5) FOR v IN ?]", [values]).fetchone()[0]
    assert [str(v) for v in found["coef_ra"]] == [str(v) for v in expected] and str(found["coef_ra"][0]) == "-0.0"
