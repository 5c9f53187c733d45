"""Queries of polynomial fits and of quantiles by selection; the SQL solves the normal equations by elimination."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.operators import fit, quantiles
from skysieve.plans.derived import cte, detections, read

QUERIES: dict = {}
SQL: dict = {}

#: Matched rows of six tiles and a sparse one: a smooth distortion, noise of a tenth of an arcsecond, and one outlier in nine.
_X, _Y = "((o_orderkey * 7919) % 2001 - 1000) / 4000.0E0", "((o_orderkey * 104729) % 2003 - 1001) / 4000.0E0"
_NOISE = "((o_orderkey * 31) % 101 - 50) / 500.0E0 + CASE WHEN o_orderkey % 9 = 4 THEN 8.0E0 + o_orderkey % 7 ELSE 0.0E0 END"
MATCHED = (
    "o_orderkey AS src_id",
    "CASE WHEN o_orderkey % 1500 = 7 THEN 'sparse' ELSE concat('tile-', CAST(o_orderkey % 6 AS STRING)) END AS tile_id",
    "100.0E0 + (o_orderkey % 6) * 10.0E0 AS ra0",
    "(o_orderkey % 6) - 3.0E0 AS dec0",
    f"100.0E0 + (o_orderkey % 6) * 10.0E0 + {_X} AS ra",
    f"(o_orderkey % 6) - 3.0E0 + {_Y} AS dec",
    f"(0.4E0 + 0.8E0 * {_X} - 0.3E0 * {_Y} + 0.5E0 * {_X} * {_X} + {_NOISE}) / 3600.0E0 AS shift_ra",
    f"(-0.7E0 + 0.2E0 * {_X} + 0.6E0 * {_Y} - 0.4E0 * {_X} * {_Y} + ((o_orderkey * 17) % 97 - 48) / 500.0E0) / 3600.0E0 AS shift_dec",
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _matched(spark, d):
    rows = read(spark, d, "orders").selectExpr(*MATCHED)
    return rows.withColumns({"ra_ref": F.col("ra") + F.col("shift_ra"), "dec_ref": F.col("dec") + F.col("shift_dec")})


_ROWS = (
    f"m AS (SELECT *, ra + shift_ra AS ra_ref, dec + shift_dec AS dec_ref FROM (SELECT {', '.join(MATCHED)} FROM orders)), "
    "u0 AS (SELECT src_id, tile_id, ra - ra0 AS x, dec - dec0 AS y, ra_ref - ra AS ox, dec_ref - dec AS oy, TRUE AS before, TRUE AS use FROM m)"
)


def features(degree: int) -> list[str]:
    return ["1.0E0", "x", "y"] + (["x * x", "x * y", "y * y"] if degree > 1 else [])


def elimination(rows: str, name: str, degree: int, least: int) -> list[str]:
    """CTEs that end in `name` (tile_id, n, ra0.., dec0..): normal equations of `rows`, reduced column by column."""
    f, p = features(degree), len(features(degree))
    cells = [f"sum({a} * {b}) AS a{i}_{j}" for i, a in enumerate(f) for j, b in enumerate([*f, "ox", "oy"])]
    out = [f"{name}_0 AS MATERIALIZED (SELECT tile_id, count(*) AS n, {', '.join(cells)} FROM {rows} WHERE use GROUP BY tile_id HAVING count(*) >= {least})"]
    for k in range(p):
        step = [f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" for j in range(k + 1, p + 2)]
        step += [f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(p) if i != k for j in range(k + 1, p + 2)]
        out.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT tile_id, n, {', '.join(step)} FROM {name}_{k})")
    final = [f"a{i}_{p} AS ra{i}, a{i}_{p + 1} AS dec{i}" for i in range(p)]
    return out + [f"{name} AS (SELECT tile_id, n, {', '.join(final)} FROM {name}_{p})"]


def _robust(degree: int, how: fit.FitConfig) -> str:
    f, out, turns = features(degree), [_ROWS], how.rounds
    for t in range(turns + 1):
        out += elimination(f"u{t}", f"c{t}", degree, how.least_matches)
        if t == turns:
            break
        value = lambda o: " + ".join(f"{o}{i} * {x}" for i, x in enumerate(f))
        gap = f"sqrt((ox - ({value('ra')})) ** 2 + (oy - ({value('dec')})) ** 2) * 3600"
        limit = f"least({how.clip_most}, CASE WHEN sigma > 0 THEN greatest({how.clip_least}, {how.clip_sigmas} * sigma) ELSE {how.clip_most} END)"
        out += [
            f"r{t} AS MATERIALIZED (SELECT u.src_id, u.tile_id, x, y, ox, oy, use, {gap} AS res FROM u{t} u LEFT JOIN c{t} USING (tile_id))",
            f"k{t} AS (SELECT r.tile_id, 1.4826 * median(abs(res - mid)) AS s, stddev_pop(res) AS sd, count(res) AS m FROM r{t} r JOIN (SELECT tile_id, median(res) AS mid FROM r{t} GROUP BY 1) USING (tile_id) GROUP BY 1)",
            f"l{t} AS MATERIALIZED (SELECT tile_id, {limit} AS edge FROM (SELECT tile_id, CASE WHEN s > 0 THEN s WHEN m > 10 THEN sd ELSE 0 END AS sigma FROM k{t}))",
            f"u{t + 1} AS MATERIALIZED (SELECT src_id, tile_id, x, y, ox, oy, use AS before, coalesce(use AND res <= edge, FALSE) AS use FROM r{t} JOIN l{t} USING (tile_id))",
        ]
    seen = " UNION ALL ".join(f"SELECT tile_id, {t} AS turn, count(*) FILTER (WHERE before) = count(*) FILTER (WHERE use) AS same FROM u{t} GROUP BY 1" for t in range(1, turns + 1))
    digits = lambda o: f"[{', '.join(f'round({o}{i} * 3600, 5)' for i in range(len(f)))}]"
    return (
        "WITH " + ",\n".join(out) + f", h AS (SELECT tile_id, coalesce(min(turn) FILTER (WHERE same), max(turn)) AS rounds FROM ({seen}) GROUP BY 1), z AS (SELECT tile_id, count(*) AS whole FROM u0 GROUP BY 1) "
        f"SELECT z.tile_id, c.n IS NOT NULL AS ok, CASE WHEN c.n IS NOT NULL THEN {digits('ra')} END AS coef_ra, CASE WHEN c.n IS NOT NULL THEN {digits('dec')} END AS coef_dec, "
        f"CAST(CASE WHEN c.n IS NULL THEN 0 ELSE rounds END AS INTEGER) AS rounds, CAST(coalesce(c.n, 0) AS BIGINT) AS kept, CAST(whole - coalesce(c.n, 0) AS BIGINT) AS dropped FROM z LEFT JOIN c{turns} c USING (tile_id) LEFT JOIN h USING (tile_id)"
    )


def _rounded(found):
    # a small negative coefficient rounds to -0.0, as in SQL; F.round alone forgets the sign
    each = lambda c: F.transform(c, lambda x: F.round(F.abs(x) * 3600, 5) * F.signum(x)).alias(c)
    return [each("coef_ra"), each("coef_dec")]


@query(_robust(2, fit.FitConfig()))
def wcsfix_polyfit(spark, d):
    """Degree two, three clip rounds; coefficients in arcseconds."""
    found = fit.fits(_matched(spark, d))
    return found.select("tile_id", "ok", *_rounded(found), "rounds", "kept", "dropped")


@query(_robust(1, fit.FitConfig(degree=1, rounds=1, clip_most=3.0)))
def wcsfix_linear(spark, d):
    found = fit.fits(_matched(spark, d), how=fit.FitConfig(degree=1, rounds=1, clip_most=3.0))
    return found.select("tile_id", "ok", *_rounded(found), "rounds", "kept", "dropped")


@query("WITH " + ",\n".join([_ROWS, *elimination("u0", "c", 1, 3)]) + " SELECT tile_id, n, [" + ", ".join(f"round(ra{i} * 3600, 5)" for i in range(3)) + "] AS coef_ra, [" + ", ".join(f"round(dec{i} * 3600, 5)" for i in range(3)) + "] AS coef_dec FROM c")
def normal_equations(spark, d):
    """Plain fits of degree one from sums."""
    rows = fit.offsets(_matched(spark, d), "tile_id")
    found = fit.least_squares(rows, ["tile_id"], 1).where("n >= 3")
    return found.select("tile_id", "n", *_rounded(found))


@query()
def plate_consensus(spark, d):
    """Fits by consensus: draws by hash, which DuckDB doesn't have; tested by brute force."""
    found = fit.consensus(_matched(spark, d), "tile_id", "src_id", tolerance_arcsec=0.5)
    return found.select("tile_id", "draw", "agree", "n", *_rounded(found))


_SCOPES = cte("det") + ", s AS (SELECT unnest(['all', CASE WHEN plate_no < 10 THEN 'low' ELSE 'high' END]) AS scope, MAG_AUTO AS v FROM det WHERE NOT isnan(MAG_AUTO))"


@query(_SCOPES + " SELECT scope, count(*) AS n, round(quantile_cont(v, 0.05), 9) AS p05, round(quantile_cont(v, 0.5), 9) AS p50, round(quantile_cont(v, 0.9), 9) AS p90, round(quantile_cont(v, 0.999), 9) AS p100 FROM s GROUP BY 1")
def selected_quantiles(spark, d):
    """Scopes as large as the table, narrowed to the wanted ranks; nothing gathers a scope's values."""
    scopes = F.explode(F.array(F.lit("all"), F.when(F.col("plate_no") < 10, "low").otherwise("high")))
    rows = detections(spark, d).select(scopes.alias("scope"), "MAG_AUTO")
    found = quantiles.exact(rows, "MAG_AUTO", (0.05, 0.5, 0.9, 0.999), ["scope"], gather=0)
    return found.select("scope", "n", *[F.round(c, 9).alias(c) for c in ("p05", "p50", "p90", "p100")])
