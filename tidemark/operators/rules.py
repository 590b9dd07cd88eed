"""Per-channel sigma and IQR rules over the long form (row, channel, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.operators.ordering import largest_group
from tidemark.operators.quantiles import SMALL_GROUP, quantiles
from tidemark.schema import FEATURES

# Fixed values.
N_SIGMA = 3.0
IQR_FACTOR = 1.5
STD_FLOOR = 1e-6
MIN_VALUES = 5
MIN_NORMALS = 30


def long_form(df: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    columns = columns or FEATURES
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ids, columns, "feature", "value")


def thresholds(train: DataFrame, columns: list[str] | None = None, group: str = "channel",
               largest: int | None = None) -> DataFrame:
    """(channel, feature, n, mean, std, q1, q3, iqr); features with fewer than five values are left out.

    ``train`` is read more than once; hand over a stored table.
    """
    tall = long_form(train, [group], columns).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    if largest is None:
        largest = largest_group(train, [group])
    basics = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")]
    if largest <= SMALL_GROUP:
        both = tall.groupBy(group, "feature").agg(
            *basics, F.percentile("value", F.lit(0.25)).alias("q1"), F.percentile("value", F.lit(0.75)).alias("q3"))
    else:
        cuts = quantiles(tall, [group, "feature"], "value", {"q1": 0.25, "q3": 0.75}, largest)
        both = tall.groupBy(group, "feature").agg(*basics).join(cuts, [group, "feature"])
    return both.filter(F.col("n") >= MIN_VALUES).select(
        group, "feature", "n", "mean", F.when(F.col("std") > STD_FLOOR, F.col("std")).otherwise(1.0).alias("std"),
        "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))


def net_thresholds(train: DataFrame, columns: list[str] | None = None, min_normals: int = MIN_NORMALS) -> DataFrame:
    """Thresholds from normal rows only; channels with too few normal rows use all their rows."""
    normals = train.filter(F.col("anomaly") == 0).groupBy("channel").agg(F.count(F.lit(1)).alias("_normals"))
    counted = train.join(normals, "channel", "left").filter(
        (F.coalesce("_normals", F.lit(0)) < min_normals) | (F.col("anomaly") == 0))
    return thresholds(counted.drop("_normals"), columns)


def sigma_rule(value: Column, mean: Column, std: Column, n_sigma: float = N_SIGMA) -> Column:
    return F.abs(value - mean) > F.lit(n_sigma) * std


def iqr_rule(value: Column, q1: Column, q3: Column, iqr: Column, factor: float = IQR_FACTOR) -> Column:
    return (value < q1 - F.lit(factor) * iqr) | (value > q3 + F.lit(factor) * iqr)


def violations(df: DataFrame, limits: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    """Long table of judged values with ``sigma_hit`` and ``iqr_hit``."""
    tall = long_form(df, ids + ["channel"] if "channel" not in ids else ids, columns)
    joined = tall.filter(F.col("value").isNotNull() & ~F.isnan("value")).join(limits, ["channel", "feature"])
    v = F.col("value")
    return joined.withColumn("sigma_hit", sigma_rule(v, F.col("mean"), F.col("std"))).withColumn(
        "iqr_hit", iqr_rule(v, F.col("q1"), F.col("q3"), F.col("iqr")))


def limits_map(limits: DataFrame) -> DataFrame:
    """One row per channel: map feature -> limits. One small map join replaces a join per value."""
    entry = F.struct("mean", "std", "q1", "q3", "iqr")
    return limits.groupBy("channel").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", entry))).alias("limits"))


def rule_hits(df: DataFrame, limits: DataFrame, columns: list[str] | None = None, count_mode: str = "feature",
              hits: str = "hits", total: str = "judged") -> DataFrame:
    """Adds hit count and number of judged features to each row, without a shuffle of the rows.

    ``feature``: a feature counts once when either test fires (0..18); ``test``: each test counts (0..36).
    A channel without limits has no hits.
    """
    columns = columns or FEATURES
    joined = df.join(limits_map(limits), "channel", "left")
    parts, judged = [], []
    for c in columns:
        v, t = F.col(c).cast("double"), F.element_at("limits", F.lit(c))
        known = v.isNotNull() & ~F.isnan(v) & t.isNotNull()
        sigma = sigma_rule(v, t["mean"], t["std"])
        iqr = iqr_rule(v, t["q1"], t["q3"], t["iqr"])
        fired = (sigma | iqr).cast("int") if count_mode == "feature" else sigma.cast("int") + iqr.cast("int")
        parts.append(F.when(known, fired).otherwise(0))
        judged.append(F.coalesce(known, F.lit(False)).cast("int"))
    def added(xs: list[Column]) -> Column:
        return F.aggregate(F.array(*xs), F.lit(0), lambda a, x: a + x).cast("long")
    return joined.withColumn(hits, added(parts)).withColumn(total, added(judged)).drop("limits")


def rule_prediction(k: int | Column | None = None, ratio: float = 0.2, hits: str = "hits",
                    total: str = "judged") -> Column:
    """``hits >= k``, or without k the share of violated features."""
    if k is not None:
        return (F.col(hits) >= k).cast("int")
    return (F.col(hits) / F.when(F.col(total) == 0, 1).otherwise(F.col(total)) >= ratio).cast("int")


def choose_k(validation: DataFrame, group: list[str] | None = None, candidates: tuple[int, ...] = (1, 2, 3),
             hits: str = "hits") -> DataFrame:
    """First k with the best F1, over all rows or per group.

    Rows are first reduced to (group, hits, label) counts, so the grid multiplies a handful of rows.
    """
    group = group or []
    cells = validation.groupBy(*group, hits, "anomaly").agg(F.count(F.lit(1)).alias("_w"))
    grid = F.explode(F.array(*[F.lit(k) for k in candidates])).alias("k")
    scored = cells.select("*", grid).groupBy(*group, "k").agg(
        *M.weighted_counts(F.col("anomaly"), (F.col(hits) >= F.col("k")).cast("int"), F.col("_w")))
    scored = scored.withColumn("f1", M.f1())
    best = W.partitionBy(*group).orderBy(F.col("f1").desc(), "k") if group else W.orderBy(F.col("f1").desc(), "k")
    return scored.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(*group, "k", "f1")


def hit_histogram(df: DataFrame, hits: str = "hits") -> DataFrame:
    """Per hit count: rows, positives, and the F1 of judging everything at or above it."""
    cells = df.groupBy(hits).agg(F.count(F.lit(1)).alias("n"), F.sum("anomaly").alias("positives"))
    down = W.orderBy(F.col(hits).desc()).rowsBetween(W.unboundedPreceding, 0)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    tp = F.sum("positives").over(down)
    flagged = F.sum("n").over(down)
    return cells.withColumn("_tp", tp).withColumn("_flagged", flagged).withColumn(
        "_pos", F.sum("positives").over(everything)).select(
        hits, "n", "positives",
        F.when(F.col("_flagged") + F.col("_pos") > 0, 2.0 * F.col("_tp") / (F.col("_flagged") + F.col("_pos")))
        .otherwise(0.0).alias("f1_at_cut"))


def marginal_contribution(df: DataFrame, limits: DataFrame, ids: list[str], columns: list[str] | None = None,
                          k: int = 1) -> DataFrame:
    """Per feature: firing rate, share fired alone, F1 alone, F1 drop when its lone hits are taken out."""
    hit = violations(df, limits, ids, columns).filter(F.col("sigma_hit") | F.col("iqr_hit"))
    per_row = hit.groupBy(*ids).agg(F.count(F.lit(1)).alias("hits"), F.collect_set("feature").alias("fired"))
    rows = df.select(*ids, "anomaly").join(per_row, ids, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    named = F.explode(F.array(*[F.lit(c) for c in columns or FEATURES])).alias("feature")
    cells = rows.withColumn("fired", F.coalesce("fired", F.array().cast("array<string>"))).select(
        "anomaly", "hits", "fired", named).select(
        "anomaly", "hits", "feature", F.array_contains("fired", F.col("feature")).alias("v"))
    cells = cells.groupBy("feature", "hits", "anomaly", "v").agg(F.count(F.lit(1)).alias("w"))
    y, w, v = F.col("anomaly"), F.col("w"), F.col("v")
    base = (F.col("hits") >= k)
    without = base & ~(v & (F.col("hits") == 1))
    def f1_of(flag: Column) -> Column:
        tp = F.sum(F.when(flag & (y == 1), w).otherwise(0))
        fp = F.sum(F.when(flag & (y == 0), w).otherwise(0))
        fn = F.sum(F.when(~flag & (y == 1), w).otherwise(0))
        return M.f1(tp, fp, fn)
    fired = F.sum(F.when(v, w).otherwise(0))
    return cells.groupBy("feature").agg(
        (fired / F.sum(w)).alias("fire_rate"),
        F.when(fired > 0, F.sum(F.when(v & (F.col("hits") == 1), w).otherwise(0)) / fired).alias("alone_share"),
        f1_of(v).alias("f1_alone"), (f1_of(without) - f1_of(base)).alias("f1_drop"))
