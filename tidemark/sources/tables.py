"""Split, recipe, alert history and corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_from_lists(spark: SparkSession, path: str) -> DataFrame:
    """(segment, split) from one JSON document with the lists fit_ids, val_ids, test_ids."""
    doc = spark.read.option("multiLine", True).schema(
        "fit_ids array<long>, val_ids array<long>, test_ids array<long>").json(path)
    parts = [doc.select(F.explode(f"{n}_ids").alias("segment"), F.lit(n).alias("split")) for n in ("fit", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def missing_segments(features: DataFrame, split: DataFrame) -> DataFrame:
    """Ids of the split that the feature table lacks, per split; all zero means complete."""
    return split.join(features.select("segment", F.lit(1).alias("_f")), "segment", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("ids"), F.count_if(F.col("_f").isNull()).alias("missing"))


def join_split(features: DataFrame, split: DataFrame) -> DataFrame:
    """Feature rows with their split; fails when the split names absent segments."""
    absent = missing_segments(features, split).agg(F.sum("missing").alias("n")).first()["n"]
    if absent:
        raise ValueError(f"{absent} segments of the split are not in the feature table")
    return features.join(split, "segment")


RECIPE = ("results struct<selection: struct<gate_perchannel_choice: map<string, struct<op: string>>, "
          "best_contamination_per_channel: map<string, double>, best_k: int>>")


def recipe_from_json(docs: DataFrame, text: str = "value") -> DataFrame:
    """(channel, op, contamination, best_k); a malformed or incomplete document yields no rows."""
    sel = F.col("d.results.selection")
    parsed = docs.select(F.from_json(text, RECIPE).alias("d")).filter(
        sel["best_k"].isNotNull() & sel["best_contamination_per_channel"].isNotNull() & (F.size(sel["gate_perchannel_choice"]) > 0))
    return parsed.select(
        F.explode(sel["gate_perchannel_choice"]).alias("channel", "c"), sel["best_contamination_per_channel"].alias("m"),
        sel["best_k"].alias("best_k")).select("channel", "c.op", F.try_element_at("m", F.col("channel")).alias("contamination"), "best_k")


def load_recipe(spark: SparkSession, path: str) -> DataFrame:
    return recipe_from_json(spark.read.text(path, wholetext=True))


def alert_table(spark: SparkSession, path: str) -> DataFrame:
    """Stored alerts with the payload read back; bad payloads read as empty."""
    return spark.read.parquet(path).withColumn(
        "summary", F.coalesce(F.get_json_object("payload", "$.summary"), F.lit("")))


def corpus_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
