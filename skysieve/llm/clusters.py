"""Centroid clustering of integer vectors: float32 screening with error intervals, exact integers where they overlap.

Vectors become whole numbers floor(scale * x). To assign a batch, one float32 matrix product gives every |c|^2 - 2 x.c
up to a rounding error that is bounded: a product of n terms in whatever order, of factors that were rounded to float32,
is off by at most g |x| |c| with g = (n + 2) u / (1 - (n + 2) u), u = 2^-24 (Cauchy and Schwarz over the sum of the terms'
magnitudes). A centroid is shortlisted unless its interval lies wholly above another's; only shortlisted centroids, one
for most vectors, are compared by exact integers, ties to the smaller number. Where numbers are too large for float32 or
for 64-bit products, all centroids are shortlisted and the integers are Python's.

Plan: vectors are stored once as whole numbers. Each round is one pass whose tasks add up their vectors by centroid
before anything moves (one row a task and centroid), a sum by centroid and component, and a collection of
k x dimension sums on the driver, whatever the table's size. Centroids travel in the task's closure: k x dimension
numbers, both parameters. No group of vectors is ever gathered, so a centroid that holds a third of all rows is only a sum.

Defined cases: vectors that are null, hold a null or non-finite component or have another dimension take no part; whole
numbers beyond 64 bits are cut to 64 bits, and so are squared distances and their sums; with fewer vectors than k
every vector starts a centroid; the first centroids are the vectors with the smallest hashes of seed and id, ties (rows that repeat an
id) in order of their components, a null id hashed as an empty string; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.llm.common import stored, table

SCALE, DIM, K, ROUNDS, SEED = 256, 64, 40, 5, 2
_TOP = (1 << 63) - 1
#: Magnitudes up to this have squared distances within 64 bits for up to 64 components; larger ones take Python integers.
EXACT = 1 << 27
#: Products of norms up to this can't overflow float32.
FLOAT = 1e37
_U = 2.0**-24


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, dim: int = DIM) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    x = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("raw")).where(F.size("raw") == dim)
    bad = F.exists("raw", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    y = x.where(~bad)
    top = float(1 << 63)

    def number(e: Column) -> Column:
        e = e.cast("double")
        return F.when(F.abs(e) < top / scale, F.floor(F.lit(float(scale)) * e)).otherwise(F.when(e > 0, F.lit(_TOP)).otherwise(F.lit(-_TOP)))

    return y.select("id", F.transform("raw", number).alias("v"))


@dataclass
class Screen:
    """What float32 screening of k centroids needs."""

    exact: np.ndarray  # (k, dim) int64

    def __post_init__(self) -> None:
        self.rounded = self.exact.astype(np.float32)
        self.norms = np.sqrt((self.exact.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        self.squares = (self.exact.astype(np.float64) ** 2).sum(1)
        self.most = float(np.abs(self.exact.astype(np.float64)).max(initial=0))

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of |c|^2 - 2 x.c for every row of x (int64) and centroid."""
        n = x.shape[1]
        lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        reach = lengths[:, None] * self.norms[None, :]
        g = (n + 2) * _U / (1 - (n + 2) * _U)
        with np.errstate(over="ignore", invalid="ignore"):
            products = (x.astype(np.float32) @ self.rounded.T).astype(np.float64)
            middle = self.squares[None, :] - 2 * products
        # the product's error, and that of the few float64 operations about it
        slack = (2 * g * reach + 1e-14 * (self.squares[None, :] + 4 * reach)) * (1 + 1e-9)
        wild = ~np.isfinite(products) | (reach > FLOAT)
        return np.where(wild, -np.inf, middle - slack), np.where(wild, np.inf, middle + slack)

    def shortlist(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of every centroid whose interval doesn't lie above another's, by row and centroid."""
        low, high = self.intervals(x)
        return np.nonzero(low <= high.min(axis=1, keepdims=True))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and squared distance of every row, exact, ties to the smaller number."""
        if not len(x):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rows, found = self.shortlist(x)
        large = self.most > EXACT or float(np.abs(x.astype(np.float64)).max()) > EXACT or x.shape[1] > 64
        if large:
            gaps = x.astype(object)[rows] - self.exact.astype(object)[found]
            squared = (gaps * gaps).sum(axis=1)
            order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], squared[i], found[i])), np.int64)
            squared = np.array([min(int(s), _TOP) for s in squared], np.int64)
        else:
            gaps = x[rows] - self.exact[found]
            squared = np.einsum("ij,ij->i", gaps, gaps)
            order = np.lexsort((found, squared, rows))
        first = order[np.unique(rows[order], return_index=True)[1]]
        return found[first], squared[first]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of the vectors of each centroid that has any."""
    k, dim = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, counts, totals = Screen(centroids), np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            cluster, _ = screen.assign(x)
            counts += np.bincount(cluster, minlength=k)
            part = x.astype(object) if len(x) and float(np.abs(x.astype(np.float64)).max()) > EXACT else x
            for c in np.unique(cluster).tolist():
                totals[c] += np.array([int(s) for s in part[cluster == c].sum(axis=0)], object)
        here = np.nonzero(counts)[0].tolist()
        text = pa.array([[str(s) for s in totals[c]] for c in here], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(counts[here], pa.int64()), text], ["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, total array<string>")
    flat = parts.select("cluster", "n", F.posexplode("total").alias("at", "s"))
    summed = flat.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in summed.orderBy("cluster", "at").collect():  # k x dim rows
        out.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["s"]))
    return out


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED, dim: int = DIM) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dim)


def fitted(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> np.ndarray:
    """(k, dim) final centroids of (id, v): `rounds` rounds of assignment and exact floor means; empty centroids stay."""
    centroids = first_centroids(vectors, k, seed, dim)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for c, (n, total) in sums(vectors, centroids).items():
            centroids[c] = [s // n for s in total]
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance): the nearest of given centroids, by squared distance."""
    kind, dim = vectors.schema["id"].dataType.simpleString(), centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            cluster, distance = screen.assign(_matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return vectors.select("id", "v").mapInArrow(run, f"id {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, dim: int = DIM, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid array<long>) of every vector that takes part."""
    spark = vectors.sparkSession
    kept = stored(whole(vectors, id_col, vector_col, scale, dim), "vectors")
    centroids = fitted(kept, k, rounds, seed, dim)
    found = stored(assigned(kept, centroids), "assigned")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # k rows
    total = min(_TOP, sum(int(r["d"]) for r in each))
    facts = [(r["cluster"], min(_TOP, int(r["d"])), total, centroids[r["cluster"]].tolist()) for r in each]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _oracle() -> str:
    """Rounds as chained tables; every vector meets every centroid in plain 64-bit integers."""
    near = "SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, k, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS d FROM v, {c}) GROUP BY r"
    out = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {DIM})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT v, sha256(concat('{SEED}:', vec_id)) AS h FROM v ORDER BY h, v LIMIT {K}))",
    ]
    for i in range(ROUNDS):
        out += [
            f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})",
            f"m{i} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM (SELECT k, p, sum(CAST(v[p] AS HUGEINT)) AS s, count(*) AS n FROM v JOIN a{i} USING (r), (SELECT unnest(range(1, {DIM + 1})) AS p) GROUP BY k, p) GROUP BY k)",
            f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))",
        ]
    out.append(f"z AS MATERIALIZED ({near.format(c=f'c{ROUNDS}')})")
    return (
        "WITH " + ",\n".join(out) + "\nSELECT vec_id, CAST(z.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.k) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM v JOIN z USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.k = z.k"
    )


ORACLE = _oracle()
