"""Exact linear-interpolated quantiles for groups of any size.

``percentile`` keeps every distinct value of a group in one task. That is fine up to ``SMALL_GROUP`` rows.
Beyond it a mergeable sketch brackets each quantile, one pass counts the values below the bracket,
and only the values inside the bracket are ranked: the answer is exact, the sketch only narrows the search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordering import largest_group

SMALL_GROUP = 2_000_000
SKETCH = 10_000


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], largest: int | None = None,
              small: int = SMALL_GROUP) -> DataFrame:
    """One row per key with a column per named probability. NULL values are ignored."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if largest is None:
        largest = largest_group(known, keys)
    if largest <= small:
        return _gathered(known, keys, value, probs)
    return _bracketed(known.withColumn(value, F.col(value).cast("double")), keys, value, probs)


def _gathered(known: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """All quantiles of a key from one set of its values: a ``percentile`` each would hold, send and sort a set each."""
    found = known.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_q"))
    return found.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])


def _bracketed(known: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    slack = 4.0 / SKETCH
    bounds = []
    for p in probs.values():
        bounds += [max(0.0, p - slack), min(1.0, p + slack)]
    sketch = known.groupBy(*keys).agg(
        F.percentile_approx(value, [float(b) for b in bounds], SKETCH).alias("_b"), F.count(value).alias("_n"))
    asked = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p"),
                 F.col("_b")[2 * i].alias("lo"), F.col("_b")[2 * i + 1].alias("hi"))
        for i, (n, p) in enumerate(probs.items())])
    brackets = sketch.select(*keys, "_n", F.explode(asked).alias("q")).select(*keys, "_n", "q.*")
    spread = known.select(*keys, F.col(value).alias("_v"))
    placed = spread.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).join(brackets, keys)
    v, c = F.col("_v"), F.col("_c")
    below = placed.groupBy(*keys, "name").agg(
        F.coalesce(F.sum(F.when(v < F.col("lo"), c)), F.lit(0)).alias("_below"),
        F.coalesce(F.sum(F.when(v <= F.col("hi"), c)), F.lit(0)).alias("_reach"),
        F.max(F.when(v < F.col("lo"), v)).alias("_under"), F.min(F.when(v > F.col("hi"), v)).alias("_over"))
    inside = placed.filter((v >= F.col("lo")) & (v <= F.col("hi")))
    upto = F.sum("_c").over(W.partitionBy(*keys, "name").orderBy("_v"))
    ranked = inside.withColumn("_upto", upto).join(below, [*keys, "name"])
    at = F.col("p") * (F.col("_n") - 1)

    def order_statistic(rank):
        found = F.min(F.when(F.col("_below") + F.col("_upto") > rank, v))
        # one rank outside the bracket is the nearest value outside it
        return F.when(F.first(rank) < F.first("_below"), F.first("_under")).when(
            F.first(rank) >= F.first("_reach"), F.first("_over")).otherwise(found)

    # The sketch only promises: a rank farther outside its bracket than one place is looked for in the whole key instead.
    missed = (F.floor(at) < F.col("_below") - 1) | (F.ceil(at) > F.col("_reach"))
    picked = ranked.groupBy(*keys, "name").agg(
        order_statistic(F.floor(at)).alias("a"), order_statistic(F.ceil(at)).alias("b"),
        F.first(at - F.floor(at)).alias("f"), F.max(missed).alias("_missed"))
    wide = picked.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).groupBy(*keys).pivot(
        "name", list(probs)).agg(F.first("x"))
    redo = picked.groupBy(*keys).agg(F.max("_missed").alias("_m"), F.count(F.lit(1)).alias("_k")).filter(F.col("_m") | (F.col("_k") < len(probs))).select(*keys)
    again = _gathered(known.join(redo, keys, "left_semi"), keys, value, probs)
    return wide.join(redo, keys, "left_anti").unionByName(again)
