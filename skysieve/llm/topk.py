"""Exact top-k by integer inner product over length buckets.

Vectors become integers floor(SCALE * x). Candidates are grouped by length into geometric buckets, and a bucket is cut
into blocks of about CANDIDATES vectors, so a length that every vector shares is still many blocks. Queries are cut into
blocks of BLOCK. First each query scores the HEAD longest vectors of its dimension, which gives a lower bound of its
k-th score. Then blocks of candidates, in groups of one length bucket, meet every block of queries whose bound they can
still reach (|q| * longest >= bound): groups are tested as narrow rows before any vector moves, and block rows join block
rows, never vector rows. Inside, each query takes its local cosine threshold bound / (|q| * longest) for that block: when
it is high, the query's largest coordinate bounds the matching coordinate of a candidate direction (coordinate pruning),
otherwise only candidates of length >= bound / |q| stay (length pruning). What is left is verified with exact integer
products, scores under the bound go, and the best k a query are merged with ties to the smaller id.

Defined cases: ids are long integers; vectors that are null or hold null or non-finite components take no part, neither do rows without id;
vectors of other dimensions than the query's don't meet it; an empty vector is a vector of dimension 0 with all scores
0; a query isn't a candidate of its own id; rows that repeat an id are each a candidate (and ids that repeat among the
queries are one query, that of the first row in order of its components); scores beyond 64 bits are cut to 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysieve.llm.common import bounded, stored, table

SCALE, K = 64, 20
#: Queries and candidates of a block, about; lengths of a bucket differ by a factor of GROWTH at most.
BLOCK, CANDIDATES, GROWTH = 1_024, 16_384, 1.25
#: Components of a block, about: blocks of long vectors have fewer of them.
COMPONENTS = 1 << 22
#: Vectors that give a first bound, and candidate blocks of a group.
HEAD, GROUP = 2_048, 4
#: Parts that the narrow join of query blocks and groups is dealt to for each dimension.
SALTS = 64
#: A local cosine threshold from which coordinates prune.
STEEP = 0.6


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v array<double> of whole numbers, dim, length) of the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"), v.alias("v"))
    bad = F.exists("raw", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    x = x.where(F.col("id").isNotNull() & F.col("raw").isNotNull() & ~bad)
    return x.select("id", "v", F.size("v").alias("dim"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)).alias("length"))


def _bucket(length: Column) -> Column:
    return F.when(length > 0, F.floor(F.log(length) / math.log(GROWTH))).otherwise(F.lit(-1_000)).cast("int")


def blocks(vectors: DataFrame, by_length: bool, most: int) -> DataFrame:
    """One row a block of `most` vectors at most, about: dim, bucket, cuts of its bucket, longest, n and the packed ids
    and components, in order of falling length. Rows that repeat an id are dealt apart."""
    keyed = vectors.withColumn("bucket", _bucket(F.col("length")) if by_length else F.lit(0))
    per = F.greatest(F.lit(1), F.least(F.lit(most), F.lit(COMPONENTS) / F.greatest(F.lit(1), F.col("dim"))))
    sizes = keyed.groupBy("dim", "bucket").agg(F.count("*").alias("m")).select("dim", "bucket", F.ceil(F.col("m") / per).cast("int").alias("cuts"))
    keyed = keyed.join(bounded(sizes), ["dim", "bucket"])  # as many rows as dimensions x bucket numbers, which the double's exponents bound
    keyed = keyed.withColumn("cut", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("cuts")).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        frame = frame.sort_values(["length", "id"], ascending=[False, True], kind="stable")
        matrix = np.array(frame["v"].tolist(), np.float64).reshape(len(frame), dim)
        one = {"dim": [dim], "bucket": [frame["bucket"].iloc[0]], "cuts": [frame["cuts"].iloc[0]], "longest": [frame["length"].iloc[0]], "n": [len(frame)]}
        return pd.DataFrame(one | {"ids": [frame["id"].to_numpy(np.int64)], "vectors": [_pack(matrix)]})

    packed = keyed.groupBy("dim", "bucket", "cut").applyInPandas(pack, "dim int, bucket int, cuts int, longest double, n int, ids array<long>, vectors binary")
    return stored(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _pack(matrix: np.ndarray) -> bytes:
    """One byte for the type, then the components in the narrowest type that holds them."""
    most = float(np.abs(matrix).max(initial=0))
    kind = next((k for k, top in (("b", 127), ("h", 32_767), ("i", 2**31 - 1)) if most <= top), "d")
    return kind.encode() + matrix.astype(kind).tobytes()


def _unpack(ids: Iterable[int], vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.array(ids, np.int64)
    return found, np.frombuffer(vectors[1:], vectors[:1].decode()).astype(np.float64).reshape(len(found), dim)


def products(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, cut to 64 bits."""
    if not others.size:
        return np.zeros(len(others), np.int64)
    most = float(np.abs(query).max(initial=0)) * float(np.abs(others).max(initial=0)) * max(1, len(query))
    if most < 2**53:
        return (others @ query).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in others], object) @ np.array([int(x) for x in query], object)
    return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in exact], np.int64)


def candidates(query: np.ndarray, norm: float, bound: float, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of a block's vectors (by falling length) whose product with the query may reach `bound`."""
    if bound <= 0 or norm <= 0 or not len(others):
        return np.arange(len(others))
    slack = 1e-9
    far = int(np.searchsorted(-lengths, -(bound / norm) * (1 - slack), side="right"))
    cosine = bound / (norm * lengths[0]) if lengths[0] > 0 else math.inf
    if cosine > 1 + slack:
        return np.empty(0, np.int64)
    if cosine < STEEP:
        return np.arange(far)
    axis = int(np.argmax(np.abs(query)))
    q, t = float(query[axis]) / norm, min(1.0, cosine)
    middle, reach = q * t, math.sqrt(max(0.0, (1 - q * q) * (1 - t * t)))
    unit = others[:far, axis] / lengths[:far]
    # the bounds hold where t is at most the cosine that is needed and q's angle is wider than the cone
    low = -1.0 if q <= -t else middle - reach
    high = 1.0 if q >= t else middle + reach
    return np.nonzero((unit >= low - slack) & (unit <= high + slack))[0]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.nonzero(scores >= cut)[0]
        keep = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
        return keep
    return np.lexsort((ids, -scores))[:k]


def block_search(q_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of each query's best k of a block (by falling length) that reach its bound.

    Queries that keep most of the block share one matrix product; the others multiply what pruning left.
    """
    norms, lengths = np.sqrt((queries**2).sum(1)), np.sqrt((others**2).sum(1))
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(others).max(initial=0)) * max(1, queries.shape[1])
    out: list[tuple] = []

    def take(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        keep = np.nonzero((scores >= bounds[i]) & (ids[at] != q_ids[i]))[0]
        top = keep[_best(ids[at[keep]], scores[keep], k)]
        out.append((np.full(len(top), q_ids[i]), ids[at[top]], scores[top]))

    wide: list[tuple[int, np.ndarray]] = []
    for i, query in enumerate(queries):
        at = candidates(query, float(norms[i]), float(bounds[i]), others, lengths)
        if 2 * len(at) > len(others) and most < 2**53 and others.size:
            wide.append((i, at))
        elif len(at):
            take(i, at, products(query, others[at]))
    for a in range(0, len(wide), 64):
        some = wide[a : a + 64]
        scores = (queries[[i for i, _ in some]] @ others.T).astype(np.int64)
        for (i, at), row in zip(some, scores, strict=True):
            take(i, at, row[at])
    return tuple(np.concatenate([x[c] for x in out]) if out else np.empty(0, np.int64) for c in range(3))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score); `is_query` is over the column id."""
    ready = integers(vectors, id_col, vector_col, scale)
    cand = blocks(ready, True, CANDIDATES)
    first = Window.partitionBy("id").orderBy("v")
    asked = blocks(ready.where(is_query).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth"), False, BLOCK)

    def search(head: int | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    q_ids, queries = _unpack(row["q_ids"], row["q_vectors"], row["dim"])
                    ids, others = _unpack(row["ids"], row["vectors"], row["dim"])
                    bounds = np.frombuffer(row["bounds"], np.float64) if row["bounds"] else np.full(len(q_ids), -np.inf)
                    cols = block_search(q_ids, queries, bounds, ids[:head], others[:head], k)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

        return run

    queries = asked.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    found = "query_id long, vec_id long, score long"
    longest = cand.groupBy("dim").agg(F.max_by("block", F.struct(F.least("n", F.lit(k + 1)), "longest", "block")).alias("block"))
    heads = cand.join(bounded(longest), ["dim", "block"]).select("dim", "ids", "vectors")
    start = queries.join(heads, "dim").withColumn("bounds", F.lit(None).cast("binary")).mapInArrow(search(HEAD), found)
    # the k-th score over some vectors is a lower bound of the k-th score over all
    bound = start.groupBy("query_id").agg(F.count("*").alias("m"), F.min("score").alias("score")).where(F.col("m") >= k).select("query_id", "score")

    def bounds_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(right["query_id"], right["score"], strict=True))
        rows = []
        for row in left.itertuples(index=False):
            q_ids, vectors_ = _unpack(row.q_ids, row.q_vectors, row.dim)
            mine, norms = np.array([known.get(i, -np.inf) for i in q_ids.tolist()], np.float64), np.sqrt((vectors_**2).sum(1))
            need = np.where(mine > 0, mine / np.where(norms > 0, norms, 1.0), -np.inf).min(initial=np.inf)
            rows.append((row.dim, row.q_block, q_ids, row.q_vectors, mine.tobytes(), float(need)))
        return pd.DataFrame(rows, columns=["dim", "q_block", "q_ids", "q_vectors", "bounds", "need"])

    members = queries.select("q_block", F.explode("q_ids").alias("query_id"))
    scored = members.join(bound, "query_id").select(F.col("q_block").alias("of"), "query_id", "score")
    ready_q = queries.groupBy("q_block").cogroup(scored.groupBy("of")).applyInPandas(bounds_of, "dim int, q_block long, q_ids array<long>, q_vectors binary, bounds binary, need double")
    ready_q = stored(ready_q, "queries")
    # groups of blocks of one bucket; narrow rows decide which groups a query block still meets
    slots = F.greatest(F.lit(1), F.ceil(F.col("cuts") / GROUP)).cast("int")
    cand = cand.withColumn("slot", F.pmod(F.xxhash64("block"), slots).cast("int"))
    groups = cand.groupBy("dim", "bucket", "slot").agg(F.max("longest").alias("longest"))
    groups = groups.withColumn("salt", F.pmod(F.xxhash64("bucket", "slot"), F.lit(SALTS)).cast("int"))
    narrow = ready_q.select("dim", "q_block", "need", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    reach = narrow.join(groups, ["dim", "salt"]).where(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("dim", "q_block", "bucket", "slot")
    pairs = reach.join(ready_q.drop("dim"), "q_block").join(cand.select("dim", "bucket", "slot", "longest", "ids", "vectors"), ["dim", "bucket", "slot"])
    every = pairs.where(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("dim", "q_ids", "q_vectors", "bounds", "ids", "vectors").mapInArrow(search(None), found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
