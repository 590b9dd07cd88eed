"""Hash-ordered splits and samples: the same rows on every run, whatever the row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform
from tidemark.operators.quantiles import quantiles


def stratified_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42, label: str = "anomaly",
                     largest: int | None = None) -> DataFrame:
    """``split``: test outside the official train rows; inside, ``share`` of each label stratum is val, the rest fit.

    The cut is a quantile of the hash inside the stratum, so no stratum is ever sorted in one task.
    """
    drawn = df.withColumn("_u", uniform(F.col(key), seed))
    cuts = quantiles(drawn.filter("train = 1"), [label, "train"], "_u", {"_cut": share}, largest)
    joined = drawn.join(F.broadcast(cuts), [label, "train"], "left")  # one row per label
    return joined.withColumn(
        "split", F.when(F.col("train") == 0, "test").when(F.col("_u") <= F.col("_cut"), "val").otherwise("fit")
    ).drop("_u", "_cut")


def split_census(df: DataFrame, target: float, tolerance: float = 0.01) -> DataFrame:
    rate = F.avg("anomaly")
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("anomaly").cast("long").alias("positives"), rate.alias("rate"),
        (F.abs(rate - target) > tolerance).alias("off_target"))


def channel_census(df: DataFrame, splits: tuple[str, ...] = ("fit", "val", "test")) -> DataFrame:
    """Rows and positives per channel and split; the NULL channel is the total."""
    aggs = []
    for s in splits:
        here = F.col("split") == s
        aggs += [F.count_if(here).alias(f"n_{s}"), F.count_if(here & (F.col("anomaly") == 1)).alias(f"pos_{s}")]
    return df.rollup("channel").agg(*aggs)


def sample_per_group(df: DataFrame, group: str, key: str, m: int, seed: int = 42, head: int | None = None) -> DataFrame:
    """m rows per group in hash order; ``head`` keeps that many of them overall."""
    u = uniform(F.col(key), seed)
    picked = df.withColumn("_u", u).withColumn(
        "_r", F.row_number().over(W.partitionBy(group).orderBy("_u", key))).filter(F.col("_r") <= m)
    if head is not None:
        picked = picked.orderBy(group, "_r").limit(head)
    return picked.drop("_u", "_r")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order: a distributed top-n."""
    return df.withColumn("_u", uniform(F.col(key), seed)).orderBy("_u", key).limit(n).drop("_u")


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str = "segment") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def split_overlap(split: DataFrame) -> DataFrame:
    """Ids that appear in more than one split, and ids in total."""
    per_id = split.groupBy("segment").agg(F.countDistinct("split").alias("_k"))
    return per_id.agg(F.count_if(F.col("_k") > 1).alias("overlapping"), F.count(F.lit(1)).alias("ids"))
