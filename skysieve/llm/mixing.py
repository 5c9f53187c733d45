"""Mixing by iterative proportional fitting: token weights raked to source, language and topic marginals.

Documents aggregate to cells (source, language, topic) with their tokens; raking multiplies cell factors until the
weighted tokens meet each target marginal; a document is then kept with a calibrated probability, decided by a hash of
its id, so a rerun keeps the same documents.

Targets are given shares by category; the share of REST goes to all categories of a marginal that aren't named, as their
tokens go. A marginal without targets keeps its observed shares. A target that no cell has is left out and the others
scaled up.

Cells are as many as combinations of the three categories. Up to CELLS of them are raked in numpy on the driver, more
by joins and aggregates between stored tables; both compute the same factors, and neither gathers an unbounded marginal.
The topic is a column expression, a register by whole-text shape unless another is given.

Defined cases: null categories are a category of their own; null and empty texts have no tokens and the probability of
their cell; a null id is hashed as such; repeated rows are decided alike; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.llm.common import BROADCAST_ROWS, stored, table

#: Cells that the driver rakes.
CELLS = 200_000
ROUNDS, TOLERANCE = 200, 1e-9
#: The share of categories that aren't named.
REST = "*"
#: The target shares of the query and of the pipeline.
TARGETS: dict[str, dict[str | None, float]] = {
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.15, REST: 0.05},
    "source": {"src0": 0.2, REST: 0.8},
    "topic": {"prose": 0.7, "brief": 0.15, "list": 0.1, "coded": 0.05},
}
#: Share of all tokens that the sample should hold.
BUDGET = 0.5
SIDES = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    """White-space separated words of a whole text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column, n_tokens: Column) -> Column:
    """A register by whole-text shape: blank, list (short lines), coded (digits and signs), brief or prose."""
    chars, lines = F.length(text), F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    marks = chars - F.length(F.translate(text, "0123456789|{}[]()<>=/_%$&#*@!", ""))
    return (
        F.when(text.isNull() | (n_tokens == 0), "blank")
        .when(marks * 10 > chars, "coded")
        .when((lines > 3) & (n_tokens < 8 * lines), "list")
        .when(n_tokens < 200, "brief")
        .otherwise("prose")
    )


def goals(cells: DataFrame, side: str, targets: dict[str | None, float] | None) -> DataFrame:
    """(key, goal): the target share of every category of a marginal that has tokens; unscaled."""
    rows = cells.groupBy(F.col(side).alias("key")).agg(F.sum("tokens").alias("t")).where("t > 0")
    if not targets:
        return rows.select("key", F.col("t").cast("double").alias("goal"))
    goal = F.lit(None).cast("double")
    for key, share in targets.items():
        if key != REST:
            goal = F.when(F.col("key").eqNullSafe(F.lit(key)), F.lit(float(share))).otherwise(goal)
    rest = rows.withColumn("goal", goal)
    others = rest.where("goal IS NULL").agg(F.sum("t")).first()[0] or 1
    return rest.select("key", F.coalesce("goal", F.col("t") / F.lit(float(others)) * float(targets.get(REST, 0.0))).alias("goal")).where("goal > 0")


def rake(weights: np.ndarray, sides: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Cell weights fitted to the target shares; `sides` give each cell's category number by marginal."""
    fitted = weights / weights.sum()
    for _ in range(rounds):
        worst = 0.0
        for codes, goal in zip(sides, targets, strict=True):
            have = np.bincount(codes, fitted, len(goal))
            present = have > 0
            goal = np.where(present, goal, 0) / max(goal[present].sum(), 1e-300)
            factor = np.where(present, goal / np.where(present, have, 1), 1)
            worst = max(worst, float(np.abs(factor[present] - 1).max(initial=0)))
            fitted = fitted * factor[codes]
        if worst < tolerance:
            break
    return fitted


def _rake_by_joins(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """As `rake`, between stored tables."""
    total = cells.agg(F.sum("tokens")).first()[0]
    now = stored(cells.where("tokens > 0").withColumn("fitted", F.col("tokens") / F.lit(total)), "cells")
    for _ in range(rounds):
        worst = 0.0
        for side in SIDES:
            have = now.groupBy(side).agg(F.sum("fitted").alias("have"))
            met = have.join(targets[side], have[side].eqNullSafe(targets[side]["key"]), "left").select(side, "have", F.coalesce("goal", F.lit(0.0)).alias("goal"))
            scale = met.agg(F.sum("goal")).first()[0]
            factors = stored(met.select(F.col(side).alias("key"), (F.col("goal") / F.lit(scale) / F.col("have")).alias("factor")).where("factor IS NOT NULL"), "factors")
            worst = max(worst, factors.agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            # a category of a table in one piece: hot ones are dealt over copies of their factor
            marked = now.withColumn("salt", F.pmod(F.xxhash64(*SIDES), F.lit(16)))
            spread = factors.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
            now = stored(marked.join(spread, marked[side].eqNullSafe(spread["key"]) & (marked["salt"] == spread["salt"])).select(*SIDES, "tokens", "n", (F.col("fitted") * F.col("factor")).alias("fitted")), "cells")
        if worst < tolerance:
            break
    return now.select(*SIDES, "fitted")


def cell_probabilities(cells: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, most_cells: int = CELLS) -> DataFrame:
    """(source, lang, topic, weight, probability): weight is fitted over observed share, and the kept tokens' expected
    share of all tokens is `budget` as far as probabilities of 1 allow."""
    spark = cells.sparkSession
    wanted = {side: goals(cells, side, (targets or {}).get(side)) for side in SIDES}
    if cells.limit(most_cells + 1).count() <= most_cells:
        rows = cells.orderBy(*SIDES).collect()
        live = [r for r in rows if r["tokens"] > 0]
        weights = np.array([float(r["tokens"]) for r in live])
        codes, marks = [], []
        for side in SIDES:
            names = {k: i for i, k in enumerate(dict.fromkeys(r[side] for r in live))}
            found = dict(wanted[side].collect())  # as many as cells at most
            codes.append(np.array([names[r[side]] for r in live], np.int64))
            marks.append(np.array([found.get(k, 0.0) for k in names]))
        fitted = rake(weights, codes, marks) if live else weights
        fit_rows = [(*(r[s] for s in SIDES), float(x)) for r, x in zip(live, fitted, strict=True)]
        fits = spark.createDataFrame(fit_rows, cells.select(*SIDES).schema.add("fitted", "double"))
    else:
        fits = _rake_by_joins(cells, wanted, ROUNDS, TOLERANCE)
    both = cells.alias("c").join(fits.alias("f"), [F.col(f"c.{s}").eqNullSafe(F.col(f"f.{s}")) for s in SIDES], "left")
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    ratio = F.coalesce(F.col("fitted") * F.lit(float(total)) / F.col("tokens"), F.lit(1.0))
    weighed = stored(both.select(*[F.col(f"c.{s}").alias(s) for s in SIDES], "tokens", ratio.alias("weight")), "weights")
    # the scale at which min(1, scale * weight) spends the budget, by bisection over aggregates
    low, high = 0.0, max(1.0, 1 / max(1e-12, weighed.where("tokens > 0").agg(F.min("weight")).first()[0] or 1.0))
    for _ in range(3):
        steps = [low + (high - low) * k / 64 for k in range(1, 65)]
        spent = weighed.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(s) * F.col("weight"))).alias(f"s{k}") for k, s in enumerate(steps)]).first()
        at = next((k for k in range(64) if (spent[k] or 0.0) >= budget * total), 63)
        low, high = (steps[at - 1] if at else low), steps[at]
    return weighed.withColumn("probability", F.least(F.lit(1.0), F.lit(high) * F.col("weight"))).drop("tokens")


def chance(key: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit("mixing")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _named(rows: DataFrame, found: DataFrame, *values: str) -> DataFrame:
    """`rows` with the values of their cells: few cells travel to the rows, many by a join over copies of hot cells."""
    cells = found.select(*[F.col(s).alias(f"c_{s}") for s in SIDES], *values)
    same = [F.col(s).eqNullSafe(F.col(f"c_{s}")) for s in SIDES]
    if cells.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(cells), same, "left")
    spread = F.sequence(F.lit(0), F.lit(63))
    return rows.withColumn("salt", F.floor(F.rand(7) * 64).cast("int")).join(cells.withColumn("c_salt", F.explode(spread)), [*same, F.col("salt") == F.col("c_salt")], "left")


def weigh(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", topic_col: Column | None = None) -> DataFrame:
    """(id, source, lang, topic, n_tokens, weight, probability, kept) of every row."""
    n = tokens(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), "source", "lang", n.alias("n_tokens"), (topic(F.col(text_col), n) if topic_col is None else topic_col).alias("topic"))
    rows = stored(rows, "tokens")
    cells = stored(rows.groupBy(*SIDES).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "cells")
    found = cell_probabilities(cells, targets, budget)
    joined = _named(rows, found, "weight", "probability")
    return joined.select("id", *SIDES, "n_tokens", "weight", "probability", (chance(F.col("id")) < F.col("probability")).alias("kept"))


def mixed(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, topic_col: Column | None = None) -> DataFrame:
    """The sampled rows of `docs`, all columns as they are, with no shuffle of texts."""
    n = tokens(F.col("text"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("source"), F.col("lang").alias("lang"), (topic(F.col("text"), n) if topic_col is None else topic_col).alias("topic"), n.alias("n_tokens"))
    cells = stored(marked.groupBy(*SIDES).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "cells")
    found = cell_probabilities(cells, targets, budget)
    return _named(marked, found, "probability").where(chance(F.col("row.doc_id")) < F.col("probability")).select("row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), TARGETS).withColumnRenamed("id", "doc_id")
