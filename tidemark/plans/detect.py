"""Batch detection: points to judged segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import forest as T
from tidemark.operators import fusion as U
from tidemark.operators import rules as R
from tidemark.operators.features import feature_summary, feature_vector, segment_features, shape_class
from tidemark.schema import FEATURES
from tidemark.session import cut_lineage


def rule_verdicts(features: DataFrame, train: DataFrame | None = None, k: int = 2, count_mode: str = "feature") -> DataFrame:
    """Rule hits of every segment against the thresholds of its channel."""
    limits = R.thresholds(features if train is None else train)
    return R.rule_hits(features, limits, FEATURES, count_mode).withColumn("rule_pred", R.rule_prediction(k))


def flagged_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged segments of the event stream: scan, features, thresholds, hits, rule."""
    from tidemark.catalog.inputs import event_points

    features = cut_lineage(segment_features(event_points(spark, sf)))
    return rule_verdicts(features).filter("rule_pred = 1").select("channel", "segment", "hits", "judged", "rule_pred")


def detect(features: DataFrame, recipe: DataFrame | None = None, threshold: float = 0.25, excluded: list[str] | None = None,
           trees: int = 100, psi: int = 128, default_contamination: float = 0.5, strong: list[str] | None = None) -> DataFrame:
    """Judged test segments. ``features`` has train = 1 for rows to fit on.

    With a recipe (channel, op, contamination, best_k) each channel uses its operator; a channel the recipe lacks uses the
    forest over all channels. Without a recipe: share of violated features, strong channels by OR, others by that forest.
    """
    features = cut_lineage(features)
    train, test = features.filter("train = 1"), features.filter("train = 0")
    vector = feature_vector()
    limits = R.thresholds(train)
    judged = R.rule_hits(test, limits)
    own = T.fit(train, vector, trees=trees, psi=psi)
    scored_train = cut_lineage(T.score(train, own, vector))
    judged = T.score(judged, own, vector)
    enough = T.sufficient(train, test).select("channel", "enough")
    if recipe is None:
        rule = R.rule_prediction()
        chosen = train.select("channel").distinct().withColumn("c", F.lit(default_contamination)).withColumn("op", F.lit(None).cast("string"))
        judged = judged.withColumn("rule_pred", rule)
        grid = [default_contamination]
    else:
        k = recipe.agg(F.max("best_k").alias("k"))
        judged = judged.join(F.broadcast(k)).withColumn("rule_pred", R.rule_prediction(F.col("k"))).drop("k")
        chosen = recipe.select("channel", F.coalesce("contamination", F.lit(default_contamination)).alias("c"), "op")
        grid = T.GRID
    cuts = T.contamination_thresholds(scored_train, grid)
    judged = U.forest_prediction(judged, cuts, chosen).join(enough, "channel", "left").withColumn(
        "if_pred", F.when(F.coalesce("enough", F.lit(False)), F.col("if_pred")).otherwise(0)).drop("enough")
    whole = T.fit(train, vector, group=None, trees=trees, psi=psi)
    base = T.contamination_thresholds(
        T.score(train, whole, vector, None).withColumn("all", F.lit("*")), [0.25], "all").select("threshold")
    judged = T.score(judged, whole, vector, None, "global_score").join(F.broadcast(base)).withColumn(
        "global_pred", (F.col("global_score") > F.col("threshold")).cast("int")).drop("threshold")
    if recipe is None:
        judged = U.strong_weak(judged, strong or [])
    else:
        judged = U.apply_gate(judged, chosen, default=F.col("global_pred"))
    rolled = U.segment_rollup(judged, threshold, excluded)
    described = judged.select("segment", shape_class().alias("anomaly_type"), feature_summary().alias("feature_summary"))
    return rolled.join(described, "segment")
