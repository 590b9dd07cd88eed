"""Writers. Stores only grow by whole partitions, so a retried batch replaces itself and a lost executor loses nothing."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.reports import latest_per_key

VERDICT_KEYS = ["segment", "channel"]


def write_features(features: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Train and test rows in partitions of their own."""
    writer = features.write.partitionBy("train").mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def cached_table(spark: SparkSession, path: str, compute) -> DataFrame:
    """Stored table if it was written completely, else computed, stored and read back."""
    if not _exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_result(results: DataFrame, folder: str, name: str, meta: dict[str, str]) -> str:
    """A run's rows as a table of their own and, once they are there, one provenance row. Earlier runs stay; gives the run's name."""
    now = datetime.now(timezone.utc)
    run = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    results.write.mode("errorifexists").parquet(f"{folder}/rows/{name}/{run}")
    row = (name, run, json.dumps(meta, ensure_ascii=False, sort_keys=True), now.replace(tzinfo=None).isoformat())
    results.sparkSession.createDataFrame([row], "name string, run string, meta string, saved_at string").write.mode("append").json(f"{folder}/runs")
    return run


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("batch", F.lit(int(batch_id))).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def append_alerts(alerts: DataFrame, path: str, batch_id: int) -> None:
    """Alert rows with the whole alert as payload; ``official`` from the segment name."""
    rows = alerts.select(
        F.col("last_ts").alias("ts"), "segment", "channel", "channel_label", "severity", "anomaly_score",
        F.col("hits").alias("rule_hits"), "first_ts", "last_ts",
        (~F.startswith("segment", F.lit("LIVE-"))).cast("int").alias("official"),
        F.to_json(F.struct(*alerts.columns)).alias("payload"), F.current_timestamp().alias("created_at"))
    _write_batch(rows, path, batch_id)


def log_verdicts(verdicts: DataFrame, path: str, batch_id: int) -> None:
    """Verdict log; the current verdict of a segment is its newest row (see ``current_verdicts``)."""
    _write_batch(verdicts, path, batch_id)


def current_verdicts(spark: SparkSession, path: str, order: tuple[str, ...] = ("batch", "ts")) -> DataFrame:
    """Latest verdict per (segment, channel)."""
    return latest_per_key(spark.read.parquet(path), VERDICT_KEYS, list(order))


def compact_verdicts(spark: SparkSession, path: str, target: str) -> None:
    """Current verdicts written to a new place, bucketed by key hash for pruned lookups."""
    current_verdicts(spark, path).withColumn("bucket", F.pmod(F.xxhash64(*VERDICT_KEYS), F.lit(64))).write.mode(
        "errorifexists").partitionBy("bucket").parquet(target)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Record log, successes and failures alike, one JSON record per line."""
    df.write.mode("append").json(path)


def write_index(posted: DataFrame, stats: DataFrame, corpus: DataFrame, folder: str, parts: int = 64) -> None:
    """Corpus, postings clustered by token, and statistics; common tokens are spread by a second hash."""
    corpus.write.mode("overwrite").parquet(f"{folder}/corpus")
    posted.repartition(parts, "token", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("token").write.mode(
        "overwrite").parquet(f"{folder}/postings")
    stats.write.mode("overwrite").parquet(f"{folder}/statistics")
