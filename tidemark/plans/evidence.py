"""Anomalies to explained anomalies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evidence as E
from tidemark.session import cut_lineage

Step = Callable[[DataFrame], DataFrame]


def template_answer(prompts: DataFrame) -> DataFrame:
    """Default generator: a fixed frame around the description, so that the chain runs without a model."""
    return prompts.withColumn("answer", F.concat_ws(
        "\n", F.lit("**【可能原因】**"), F.col("description"), F.lit("**【来源】**"), F.concat(F.lit("pieces: "), F.col("pieces").cast("string"))))


def explain(anomalies: DataFrame, labels: DataFrame, retrieve: Step, generate: Step = template_answer,
            most: int | None = None, budget: float = 2000.0) -> DataFrame:
    """One row per anomaly: query, context, prompt, answer, success.

    ``retrieve`` maps (query_id, text) to ranked results, ``generate`` adds ``answer``. No result: the fixed refusal.
    A NULL answer is a failure and stays as a row. ``most`` keeps the highest scores.
    """
    if most is not None:
        anomalies = anomalies.orderBy(F.desc("anomaly_score"), "segment").limit(most)
    named = anomalies.join(labels.select("channel", "label"), "channel", "left").withColumn("label", F.coalesce("label", "channel"))
    described = named.withColumn("description", E.describe_anomaly(
        F.col("label"), F.col("anomaly_type"), F.col("anomaly_score"), F.col("feature_summary")))
    asked = cut_lineage(described.withColumn("query", E.query_text(F.col("channel"), F.col("anomaly_type"), F.col("description"))))
    results = retrieve(asked.select(F.col("segment").alias("query_id"), F.col("query").alias("text")))
    packed = E.pack_context(results, budget)
    joined = asked.join(packed.withColumnRenamed("query_id", "segment"), "segment", "left")
    prompted = joined.withColumn("prompt", E.anomaly_prompt(F.col("channel"), F.col("anomaly_type"), F.col("description"), F.col("context")))
    empty = F.coalesce("context", F.lit("")) == ""
    answered = generate(prompted.withColumn("pieces", F.coalesce("pieces", F.lit(0))))
    return answered.withColumn("answer", F.when(empty, E.REFUSAL).otherwise(F.col("answer"))).withColumn(
        "success", F.col("answer").isNotNull() & ~F.coalesce(E.garbled(F.col("answer")), F.lit(False)))
