"""Exact interpolated quantiles by distributed selection: no task holds the values of a scope.

Every wanted rank has a bracket of values that holds it. A round sketches the values inside the brackets (a mergeable sketch of bounded size),
takes the grid values on both sides of the rank, and counts exactly how many values lie below, at and between them; the
bracket becomes the part that holds the rank, or the value itself where a tie holds it. The counts decide, so the sketch only has to be
near. Each round leaves about a sixtieth of a bracket; when few values are left, they are numbered in order.
Scopes of few values are plain aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skysieve.functions.sky import finite
from skysieve.session import cut

#: Values of a scope that an aggregate may hold; values of a bracket that are numbered; steps of the sketch's grid.
GATHER, FEW, GRID = 200_000, 1_000, 128
#: Brackets that are broadcast at most.
BROADCAST = 100_000


def name_of(q: float) -> str:
    return f"p{round(q * 100):02d}"


def exact(df: DataFrame, value: str, quantiles: Sequence[float], group: Sequence[str] = (), gather: int = GATHER) -> DataFrame:
    """(group, n, p<percent> of each quantile) of the finite values: linear interpolation between the two nearest ranks."""
    scope = F.to_json(F.struct(*group)) if group else F.lit("all")  # nulls are left out, so they are a scope of their own
    values = df.where(finite(value)).select(*group, F.col(value).cast("double").alias("__x"))
    x = values.select(scope.alias("__scope"), "__x")
    sizes = cut(values.groupBy(*group).agg(F.count("*").alias("n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")).withColumn("__scope", scope))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= gather:
        return values.groupBy(*group).agg(F.count("*").alias("n"), *[F.percentile("__x", F.lit(q)).alias(name_of(q)) for q in quantiles])
    place = [F.lit(float(q)) * (F.col("n") - 1) for q in quantiles]
    ranks = F.explode(F.array_distinct(F.array(*[edge(p).cast("long") for p in place for edge in (F.floor, F.ceil)])))
    state = cut(sizes.where("n > 0").select("__scope", ranks.alias("__rank"), "__lo", "__hi", F.lit(0).cast("long").alias("__below"), F.col("n").alias("__in")))
    open_ = (F.col("__in") > FEW) & (F.col("__lo") < F.col("__hi"))
    while not (wide := state.where(open_)).isEmpty():
        state = cut(_narrowed(x, wide).unionByName(state.where(~open_)))
    order = Window.partitionBy("__scope", "__rank").orderBy("__x")
    picked = _inside(x, state.where("__lo < __hi")).withColumn("__nth", F.row_number().over(order)).where("__nth - 1 = __rank - __below")
    found = picked.select("__scope", "__rank", F.col("__x").alias("__value")).unionByName(state.where("__lo >= __hi").select("__scope", "__rank", F.col("__lo").alias("__value")))
    by_rank = cut(found.groupBy("__scope").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__value"))).alias("__values")))  # two ranks a quantile
    out = sizes.join(by_rank, "__scope", "left")
    columns = []
    for q, p in zip(quantiles, place, strict=True):
        low, high = F.floor(p), F.ceil(p)
        u, v = F.col("__values")[low.cast("long")], F.col("__values")[high.cast("long")]
        columns.append(F.when((low == high) | (u == v), u).otherwise((high - p) * u + (p - low) * v).alias(name_of(q)))
    return out.select(*group, "n", *columns)


def _inside(x: DataFrame, brackets: DataFrame) -> DataFrame:
    """Values within each bracket of their scope, with the bracket's columns. Few brackets are broadcast, so that values stay
    where they are; a shuffle by scope would give a task a whole scope."""
    few = brackets.select("__scope").limit(BROADCAST + 1).count() <= BROADCAST
    return x.join(F.broadcast(brackets) if few else brackets, "__scope").where("__x >= __lo AND __x <= __hi")


def _narrowed(x: DataFrame, wide: DataFrame) -> DataFrame:
    """The brackets after a round."""
    keys = ["__scope", "__rank", "__lo", "__hi", "__below", "__in"]
    grid = F.percentile_approx("__x", [k / GRID for k in range(GRID + 1)], 10 * GRID)
    sketch = _inside(x, wide).groupBy(*keys).agg(grid.alias("__grid"))
    share = (F.col("__rank") - F.col("__below")) * F.lit(float(GRID)) / F.col("__in")
    at = lambda k: F.element_at("__grid", (F.greatest(F.lit(0), F.least(F.lit(GRID), k)) + 1).cast("int"))
    aimed = cut(sketch.select(*keys, at(F.floor(share) - 1).alias("__u"), at(F.ceil(share) + 1).alias("__v")))
    v = F.col("__x")
    counted = _inside(x, aimed).groupBy(*keys, "__u", "__v").agg(
        F.count_if(v < F.col("__u")).alias("__c1"), F.count_if(v <= F.col("__u")).alias("__e1"), F.count_if(v < F.col("__v")).alias("__c2"), F.count_if(v <= F.col("__v")).alias("__e2"),
        F.max(F.when(v < F.col("__u"), v)).alias("__before_u"), F.min(F.when(v > F.col("__u"), v)).alias("__after_u"), F.max(F.when(v < F.col("__v"), v)).alias("__before_v"), F.min(F.when(v > F.col("__v"), v)).alias("__after_v"),
    )
    r, c1, e1, c2, e2 = F.col("__rank") - F.col("__below"), F.col("__c1"), F.col("__e1"), F.col("__c2"), F.col("__e2")
    cases = (  # condition, then the bracket's low and high value, the rows below it and inside it
        ((r >= c1) & (r < e1), "__u", "__u", c1, e1 - c1),
        ((r >= c2) & (r < e2), "__v", "__v", c2, e2 - c2),
        ((r >= e1) & (r < c2), "__after_u", "__before_v", e1, c2 - e1),
        (r < c1, "__lo", "__before_u", F.lit(0), c1),
        (F.lit(True), "__after_v", "__hi", e2, F.col("__in") - e2),
    )

    def choose(k: int) -> Column:
        out = F.lit(None)
        for case in reversed(cases):
            out = F.when(case[0], F.col(case[k]) if isinstance(case[k], str) else case[k]).otherwise(out)
        return out

    return counted.select("__scope", "__rank", choose(1).alias("__lo"), choose(2).alias("__hi"), (F.col("__below") + choose(3)).cast("long").alias("__below"), choose(4).cast("long").alias("__in"))
