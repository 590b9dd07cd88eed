"""Evaluation of predictions: counts, groups, bootstrap, comparisons."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import metrics as M
from tidemark.operators.ordering import largest_group
from tidemark.session import cut_lineage


def evaluate(df: DataFrame, pred: str = "pred", truth: str = "anomaly", group: list[str] | None = None) -> DataFrame:
    """One row of metrics per group, or one row."""
    group = group or []
    return df.groupBy(*group).agg(*M.counts(F.col(truth), F.col(pred))).select(*group, *M.all_metrics())


def evaluate_with_total(df: DataFrame, pred: str = "pred", truth: str = "anomaly", group: str = "channel") -> DataFrame:
    """Metrics per group and, with a NULL group, over everything, from one pass."""
    return df.rollup(group).agg(*M.counts(F.col(truth), F.col(pred))).select(group, *M.all_metrics())


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw by inversion of a uniform number, up to 9 (the tail beyond has mass 1e-7)."""
    total, term, out = 0.0, 0.36787944117144233, F.lit(9)
    bounds = []
    for k in range(9):
        total += term
        bounds.append((k, total))
        term /= k + 1
    for k, bound in reversed(bounds):
        out = F.when(u < bound, k).otherwise(out)
    return out


def poisson_draw(key: Column, tag: Column) -> tuple[Column, Column]:
    """The draw of ``poisson_weight`` of a uniform number in two columns: the digest's first eight digits, to be kept as ``_digits``, and the weight read from them.

    A digest is made once and its digits are compared with the bounds as they are: u < bound is digits < ceil(bound * 2^32).
    """
    total, term, out = 0.0, 0.36787944117144233, F.lit(9)
    bounds = []
    for k in range(9):
        total += term
        bounds.append((k, f"{math.ceil(total * 4294967296.0):08x}"))
        term /= k + 1
    for k, bound in reversed(bounds):
        out = F.when(F.col("_digits") < bound, k).otherwise(out)
    return F.substring(F.md5(F.concat_ws("#", key.cast("string"), tag)), 1, 8), out


@F.pandas_udf(T.LongType())
def _poisson(n: pd.Series, tag: pd.Series) -> pd.Series:
    """Poisson(n) draw per row, seeded by its tag: the sum of n Poisson(1) weights."""
    seeds = [int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big") for t in tag]
    return pd.Series([int(np.random.default_rng(s).poisson(k)) for s, k in zip(seeds, n)])


def replicate_counts(df: DataFrame, key: str, preds: list[str], truth: str = "anomaly", n_boot: int = 1000,
                     seed: int = 42, method: str = "rows") -> DataFrame:
    """Confusion counts of every bootstrap replicate in one pass.

    ``rows``: each row gets a Poisson(1) weight per replicate from a hash, summed map-side into (replicate, truth,
    predictions) cells. ``cells``: rows are counted into those few cells first and each replicate draws the cell's weight,
    which has the same distribution and costs nothing per row, but other draws. The table's size has no say in it.
    """
    replicate = F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("replicate")
    if method == "rows":
        tag = F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"))
        digits, weight = poisson_draw(F.col(key), tag)
        # a row makes n_boot draws: a table in a few files is dealt to all cores before that
        dealt = df.select(key, truth, *preds).repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
        draws = dealt.select(key, truth, *preds, replicate)
        cells = draws.withColumn("_digits", digits).withColumn("_w", weight).groupBy("replicate", truth, *preds).agg(
            F.sum("_w").alias("_w"))
    else:
        counted = df.groupBy(truth, *preds).agg(F.count(F.lit(1)).alias("_n"))
        names = [F.col(c).cast("string") for c in ("replicate", truth, *preds)]
        cells = counted.select("*", replicate).withColumn("_w", _poisson("_n", F.concat_ws(":", F.lit(str(seed)), *names)))
    named = []
    for p in preds:
        for n, c in zip(("tn", "fp", "fn", "tp"), M.weighted_counts(F.col(truth), F.col(p), F.col("_w"))):
            named.append(c.alias(f"{p}_{n}"))
    return cells.groupBy("replicate").agg(*named)


def _f1_of(p: str) -> Column:
    return M.f1(F.col(f"{p}_tp"), F.col(f"{p}_fp"), F.col(f"{p}_fn"))


def bootstrap_f1(df: DataFrame, key: str, pred: str = "pred", truth: str = "anomaly", n_boot: int = 1000,
                 seed: int = 42, method: str = "rows") -> DataFrame:
    """95 % percentile interval of F1."""
    reps = replicate_counts(df, key, [pred], truth, n_boot, seed, method).select(_f1_of(pred).alias("f1"))
    return reps.agg(F.percentile("f1", F.lit(0.025)).alias("f1_low"), F.percentile("f1", F.lit(0.975)).alias("f1_high"),
                    F.count("f1").alias("n_boot"))


def paired_bootstrap(df: DataFrame, key: str, pred_a: str, pred_b: str, truth: str = "anomaly", n_boot: int = 1000,
                     seed: int = 42, method: str = "rows") -> DataFrame:
    """Interval of F1(b) - F1(a) on shared weights and the share of replicates where b is ahead."""
    reps = replicate_counts(df, key, [pred_a, pred_b], truth, n_boot, seed, method).select(
        (_f1_of(pred_b) - _f1_of(pred_a)).alias("delta"))
    return reps.agg(
        F.percentile("delta", F.lit(0.025)).alias("delta_low"), F.percentile("delta", F.lit(0.975)).alias("delta_high"),
        F.avg("delta").alias("delta_mean"), F.avg((F.col("delta") > 0).cast("double")).alias("p_gain"))


def contribution_verdict(base: DataFrame, other: DataFrame, group: str = "channel") -> DataFrame:
    """Does the other method help a group? Inputs are evaluation tables."""
    a, b = base.select(group, F.col("f1").alias("f1_base"), "n"), other.select(group, F.col("f1").alias("f1_other"))
    delta = F.col("f1_other") - F.col("f1_base")
    return a.join(b, group).select(
        group, "n", "f1_base", "f1_other", delta.alias("delta"),
        F.when(F.col("n") < M.SMALL_SAMPLE, "small_n_not_significant").when(delta > 1e-9, "positive")
        .when(delta < -1e-9, "negative").otherwise("neutral").alias("verdict"))


def seed_statistics(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Two settings over seeds: mean, sample deviation, range, overlap of the ranges, every difference positive."""
    return runs.agg(
        *[f(c).alias(f"{c}_{n}") for c in (a, b)
          for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))],
        ((F.min(a) <= F.max(b)) & (F.min(b) <= F.max(a))).alias("overlap"),
        F.every(F.col(b) > F.col(a)).alias("all_positive"))


def without_group(df: DataFrame, name: str, pred: str = "pred", group: str = "channel") -> DataFrame:
    """Metrics with all rows, and with one group's predictions forced to normal."""
    forced = df.withColumn(pred, F.when(F.col(group) == name, 0).otherwise(F.col(pred)))
    return evaluate(df, pred).withColumn("mode", F.lit("all")).unionByName(
        evaluate(forced, pred).withColumn("mode", F.lit("without")))


def deviation_level(value: Column, reference: Column, near: float = 0.02, far: float = 0.05) -> Column:
    gap = F.abs(value - reference)
    return F.when(gap <= near, "ok").when(gap <= far, "drift").otherwise("off")


def additivity(table: DataFrame, value: str = "f1") -> DataFrame:
    """Row with base, b, c, d: is the joint effect the sum of the two single effects?"""
    joint, sum_of = F.col("d") - F.col("base"), (F.col("b") - F.col("base")) + (F.col("c") - F.col("base"))
    return table.select(joint.alias("joint"), sum_of.alias("sum_of_single"), (joint - sum_of).alias("interaction"))


def tables_differ(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one table and not in the other, both ways; empty means identical as multisets."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right")))


def agreement(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Row-wise mismatches of two runs by key; rows present on one side only are counted too."""
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
        *[F.count_if(F.col("_a") & F.col("_b") & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"diff_{c}")
          for c in columns])


LARGE_KEY = 2_000_000


def auc(tall: DataFrame, keys: list[str], value: str = "value", truth: str = "anomaly", largest: int | None = None,
        large: int = LARGE_KEY) -> DataFrame:
    """Area under the ROC curve per key (feature, seed, candidate) from rank sums with tied ranks averaged.

    Values are reduced to (key, value) counts first. A key with more distinct values than one task should order
    is range-partitioned by value; the parts' totals give each part its starting rank.
    """
    cells = tall.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(truth).alias("_p"))
    if largest is None:
        cells = cut_lineage(cells)
        largest = largest_group(cells, keys)
    if largest <= large:
        upto = F.sum("_n").over(W.partitionBy(*keys).orderBy(value))
        ranked = cells.withColumn("_rank", upto - (F.col("_n") - 1) / 2.0)
    else:
        parts = max(2, -(-cells.count() // large))
        cut = cut_lineage(cells.repartitionByRange(parts, *[F.col(k) for k in keys], F.col(value)).withColumn("_s", F.spark_partition_id()))
        before = cut.groupBy(*keys, "_s").agg(F.sum("_n").alias("_sn")).withColumn(
            "_before", F.sum("_sn").over(W.partitionBy(*keys).orderBy("_s")) - F.col("_sn")).drop("_sn")
        upto = F.sum("_n").over(W.partitionBy(*keys, "_s").orderBy(value))
        ranked = cut.withColumn("_upto", upto).join(before, [*keys, "_s"]).withColumn(
            "_rank", F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0)
    n1, n0 = F.sum("_p"), F.sum(F.col("_n") - F.col("_p"))
    area = (F.sum(F.col("_rank") * F.col("_p")) - n1 * (n1 + 1) / 2.0) / (n1 * n0)
    return ranked.groupBy(*keys).agg(
        F.sum("_n").alias("n"), n1.alias("positives"), F.when((n1 > 0) & (n0 > 0), area).otherwise(0.5).alias("auc"))
