"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shelf


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(id, root) for every id of ``edges`` (a, b) but the roots themselves; root is the least id of the component.

    Every round hangs neighbours on smaller neighbours, by sums per id that combine before they are shuffled and joins that skew
    handling can split. The rounds grow with the logarithm of the longest chain. Each round's edges are a stored table.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = shelf.put(tidy(edges), "edges-0")
    seen, n = state(now), 0
    while seen[0]:
        least = now.groupBy(F.col("b").alias("b")).agg(F.min("a").alias("low")).unionByName(
            now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("low"))).groupBy("b").agg(F.min("low").alias("low"))
        large = now.join(least, "b").select("a", F.least("b", "low").alias("b")).filter("a <> b").distinct()
        large = shelf.put(large, f"large-{n}")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        after = shelf.put(tidy(small), f"edges-{n + 1}")
        shelf.drop(f"large-{n}")
        shelf.drop(f"edges-{n}")
        now, n, last = after, n + 1, seen
        seen = state(now)
        if seen == last:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
