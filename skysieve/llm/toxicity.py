"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts; everything else is unlabelled. A linear numpy classifier over word presence is
trained on the class-prior-corrected risk  pi R_P(+) + max(0, R_U(-) - pi R_P(-))  with the sigmoid loss; where the
bracket turns negative, the step climbs back instead (Kiryo et al. 2017).

The documents that hold a word are counted over all training rows. Of the words of positives those become features whose
share of positives is no chance: Chernoff's bound, exp(-n KL(share || overall share)), is so small that only `chance` of
all the words would pass if none told anything; the `vocabulary` most telling ones where there are more. The risk is then
fitted on bounded samples chosen by hash of the id: up to `max_positive` positives
for R_P, and up to `max_unlabelled` of all training rows, positives among them, for R_U. All four are parameters. The
class prior is one too; unless given it is the toxic share of all confirmed labels of the training rows, an aggregate over
the whole table. Scoring reads every whole text once, row by row.

Defined cases: null and empty texts score as a text without any word; without a positive row every score is the prior;
rows whose id is null are never learned from and count as held out; rows that repeat an id are scored each and teach
once; extra columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.llm.common import fold, stored, table

MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000
VOCABULARY = 16_384
#: Words that may become features by chance, expected.
CHANCE = 0.1
#: Words that a task counts before it passes them on.
COUNTED = 200_000
ROUNDS, RATE, DECAY = 600, 0.05, 1e-4

#: ASCII letters in lower case; other ASCII bytes end a word.
_WORDS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


#: Bytes of a word's beginning that count as a word of their own, marked by a byte that no word has.
STEMS = (5,)


def words(text: bytes | None) -> set[bytes]:
    """Distinct words of a whole text, and the beginnings of the longer ones."""
    if not text:
        return set()
    found = set(text.translate(_WORDS).split())
    return found.union(*[{w[:n] + b"*" for w in found if len(w) > n} for n in STEMS])


@dataclass
class ToxicModel:
    weights: dict[bytes, float]
    bias: float

    def scores(self, texts: Iterable[bytes | None]) -> np.ndarray:
        known = self.weights.keys()
        logits = np.array([self.bias + sum(self.weights[w] for w in words(x) & known) for x in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, features: int, prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias) of the linear classifier over a presence matrix given as (row, column) pairs.

    Rows that are not positive are the unlabelled sample; a text that is in both samples is two rows.
    """
    n, (pos, unl) = len(positive), (positive, ~positive)
    parts = {"P": pos / max(1, pos.sum()), "U": unl / max(1, unl.sum())}
    theta, first, second = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, ROUNDS + 1):
        z = np.bincount(rows, theta[cols], n) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        slope = s * (1 - s)
        # sigmoid loss of label +1 is 1 - s, of label -1 is s
        negative = parts["U"] @ s - prior * (parts["P"] @ s)
        to_negative = (parts["U"] - prior * parts["P"]) * slope
        dz = to_negative - prior * parts["P"] * slope if negative >= 0 else -to_negative
        grad = np.append(np.bincount(cols, dz[rows], features), dz.sum())
        grad[:-1] += DECAY * theta[:-1] / max(1, features)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def risk(scores: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The non-negative risk estimate of scores under the sigmoid loss."""
    p, u = scores[positive], scores[~positive]
    mean = lambda x: float(x.mean()) if len(x) else 0.0
    return prior * mean(1 - p) + max(0.0, mean(u) - prior * mean(p))


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, n): the documents that hold each word, over all rows of column text; tasks add up before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for x in batch.column(0):
                held.update(words(x.as_py()))
                if len(held) > COUNTED:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*held], pa.binary()), pa.array([*held.values()], pa.int64())], ["w", "n"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    prior: float | None = None,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
    vocabulary: int = VOCABULARY,
    chance: float = CHANCE,
) -> ToxicModel:
    """The model from rows of `docs` that `train` (over doc_id) accepts and from `labels` (doc_id, toxic) of the same ids."""
    spark, hashed = docs.sparkSession, F.xxhash64("doc_id")
    known = labels.where(train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("toxic").isNotNull())
    toxic, total = known.agg(F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0)), F.count("*")).first()
    prior = float(np.clip(prior if prior is not None else toxic / max(1, total), 1e-3, 0.5))
    picked = [r[0] for r in known.where("toxic = 1").select("doc_id").orderBy(hashed, "doc_id").limit(max_positive).collect()]
    if not picked:
        return ToxicModel({}, float(np.log(prior / (1 - prior))))
    teach = docs.where(train & F.col("doc_id").isNotNull()).select("doc_id", "text")
    others = [r[0] for r in teach.select("doc_id").distinct().orderBy(hashed, "doc_id").limit(max_unlabelled).collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = spark.createDataFrame([(i, True) for i in picked] + [(i, False) for i in others], f"doc_id {kind}, positive boolean")

    # rows that repeat an id are one text of the sample, so it stays within its bounds
    texts = teach.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.max("text").alias("text"))
    sample = stored(texts.select("positive", F.col("text").cast("binary").alias("text")), "sample")
    p, n = max(1, sample.where("positive").count()), max(1, teach.count())
    common = word_counts(sample.where("positive").select("text")).withColumnRenamed("n", "p")
    counts = stored(common.join(word_counts(teach), "w"), "words")  # a word of the positives is a word of all
    overall, share = min(0.5, p / n), F.least(F.lit(1.0), F.col("p") / F.col("n"))
    kl = share * F.log(share / overall) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - overall))).otherwise(0.0)
    telling = counts.withColumn("g", F.col("n") * kl).where(F.col("g") >= float(np.log(max(1, counts.count()) / chance))).orderBy(F.desc("g"), "w").limit(vocabulary)
    features = [bytes(r["w"]) for r in telling.select("w").collect()]
    at = {w: i for i, w in enumerate(features)}

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(at[w] for w in words(x.as_py()) & at.keys()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["positive", "ids"])

    pairs = sample.mapInArrow(index, "positive boolean, ids array<int>").toPandas()
    lengths = pairs["ids"].map(len).to_numpy(np.int64)
    cols = np.concatenate([*pairs["ids"], np.empty(0, np.int64)]).astype(np.int64)
    weights, bias = nnpu(np.repeat(np.arange(len(pairs)), lengths), cols, pairs["positive"].to_numpy(bool), len(features), prior)
    return ToxicModel({w: float(x) for w, x in zip(features, weights, strict=True) if x}, bias)


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of `docs`."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x.as_py() for x in batch.column(1)))], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, score double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), fold("doc_id", 5) != 0)
    held = F.coalesce(fold("id", 5) == 0, F.lit(True))
    return score(docs, model).select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
