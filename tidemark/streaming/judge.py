"""Judgement of closed segments, micro-batch by micro-batch, with the batch operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import severity as V
from tidemark.operators import forest as T
from tidemark.operators import fusion as U
from tidemark.operators import rules as R
from tidemark.operators.evidence import general_format
from tidemark.operators.features import feature_vector, segment_features
from tidemark.operators.reports import latest_per_key
from tidemark.schema import FEATURES
from tidemark.session import cut_lineage
from tidemark.sinks.tables import append_alerts, log_verdicts
from tidemark.streaming import growing
from tidemark.streaming.segments import to_points

MIN_POINTS = 3
CONTAMINATION = 0.2


@dataclass
class Judge:
    """What judging needs: limits for all channels; forests, cuts and display scale for the strong ones."""

    limits: DataFrame
    strong: list[str] = field(default_factory=list)
    forest: DataFrame | None = None
    cuts: DataFrame | None = None
    scale: DataFrame | None = None

    @classmethod
    def train(cls, features: DataFrame, strong: list[str], trees: int = 100, psi: int = 256) -> Judge:
        """Fit on the train rows; forests only for the strong channels with enough rows."""
        train = cut_lineage(features.filter("train = 1"))
        limits = cut_lineage(R.thresholds(train))
        own = train.filter(F.col("channel").isin(strong))
        forest = cut_lineage(T.fit(own, feature_vector(), trees=trees, psi=psi))
        scored = cut_lineage(T.score(own, forest, feature_vector()).filter("score IS NOT NULL"))
        cuts = cut_lineage(T.contamination_thresholds(scored, [CONTAMINATION]).select("channel", "threshold"))
        margins = scored.join(cuts, "channel").withColumn("score", F.col("score") - F.col("threshold"))
        return cls(limits, strong, forest, cuts, cut_lineage(T.display_scale(margins)))

    def features(self, closed: DataFrame) -> DataFrame:
        """A run is named by its first clock too: an id that comes back in a batch is a segment of its own."""
        keys = ["channel", "segment", "run"]
        rows = segment_features(to_points(closed), keys, rounding="round")
        return rows.join(closed.select("channel", "segment", F.get("clocks", F.lit(0)).alias("run"), "official", "provisional",
                                       F.element_at("values", -1).alias("last_value")), keys)

    def judge(self, features: DataFrame) -> DataFrame:
        """Verdict columns for feature rows."""
        rows = R.rule_hits(features, self.limits, FEATURES, "test")
        if self.forest is None:
            none = F.lit(None).cast("double")
            rows = rows.withColumns({"margin": none, "tau95": F.lit(0.0), "score_std": F.lit(1.0)})
        else:
            rows = T.score(rows, self.forest, feature_vector()).join(self.cuts, "channel", "left").join(
                self.scale, "channel", "left").withColumn("margin", F.col("score") - F.col("threshold"))
        return U.verdicts(rows, self.strong)


def verdict_rows(judged: DataFrame) -> DataFrame:
    return judged.select(
        "segment", "channel", (F.unix_micros("last_ts") / 1e6).alias("ts"), F.col("len").alias("n_points"),
        F.col("is_anomaly").cast("int").alias("is_anomaly"), "severity", F.col("raw_score").alias("score"),
        F.to_json(F.struct(*FEATURES)).alias("features"))


def alert_rows(judged: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Alert payload of anomalous segments."""
    rows = judged.filter("is_anomaly")
    if labels is not None:
        rows = rows.join(labels.select("channel", F.col("label").alias("channel_label")), "channel", "left")
        rows = rows.withColumn("channel_label", F.coalesce("channel_label", "channel"))
    else:
        rows = rows.withColumn("channel_label", F.col("channel"))
    forest = F.when(F.col("if_flag"), "IF:异常").when(~F.col("if_flag"), "IF:正常").otherwise("IF:—(弱通道纯规则)")
    summary = F.format_string(
        "【实时·Stage 2】%s 段%s 判定异常 · %s · 规则违例 %d 条(≥2 判异常) · len=%d mean=%s std=%s · RAG 诊断待生成",
        "channel_label", "segment", forest, "hits", "len", general_format(F.col("mean")), general_format(F.col("std")))
    return rows.select(
        "segment", "channel", "channel_label", (F.unix_micros("first_ts") / 1e6).alias("first_ts"),
        (F.unix_micros("last_ts") / 1e6).alias("last_ts"), F.round("raw_score", 4).alias("raw_score"), "anomaly_score", "severity",
        "hits", F.lit("unclassified (live)").alias("anomaly_type"), summary.alias("summary"))


def judged_rows(judged: DataFrame) -> DataFrame:
    """Score, severity and last value of closed and growing segments; a growing one is shown by the forest or its hits and is never an alert."""
    forest = F.when(F.col("if_flag").isNotNull(), F.col("margin"))
    preview = F.coalesce(forest, F.col("hits").cast("double"))
    shown = V.by_preview(forest, F.col("hits"), F.col("tau95"), F.col("score_std"))
    growing_ = F.col("provisional")
    return judged.select(
        "channel", "segment", "run", (F.unix_micros("last_ts") / 1e6).alias("ts"), F.col("last_value").alias("value"),
        F.round(F.when(growing_, preview).otherwise(F.col("raw_score")), 4).alias("score"), F.when(growing_, shown).otherwise(F.col("severity")).alias("severity"),
        "provisional", (F.col("is_anomaly") & ~growing_).alias("is_anomaly"), F.when(growing_, F.col("len")).alias("open_len"))


def _growing_features(rows: DataFrame, batch_id: int, folder: str) -> DataFrame:
    """Features of a batch of growing-segment rows; late points and swings that were handed out go to stores of their own."""
    log_verdicts(rows.filter("kind = 'late'").select("channel", "segment", F.timestamp_micros("first_clock").alias("timestamp"), F.col("last_value").alias("value")),
                 f"{folder}/late", batch_id)
    told = rows.agg(F.max((F.col("kind") == "swings").cast("int")).alias("new"), F.max(F.coalesce(F.col("handed"), F.lit(False)).cast("int")).alias("used")).first()
    if told.new:
        log_verdicts(rows.filter("kind = 'swings'").select("channel", "run", "series", "swings"), f"{folder}/swings", batch_id)
    swings = rows.sparkSession.read.parquet(f"{folder}/swings").filter(F.col("batch") <= batch_id) if told.used else None
    return growing.statistics(rows, swings)


def judge_batch(judge: Judge, closed: DataFrame, batch_id: int, folder: str, labels: DataFrame | None = None) -> None:
    """Stores of one micro-batch: verdicts, alerts, judged rows, latest scores, counters, late points. Every write names the batch, so a retry replaces it.

    ``closed`` has whole segments (``segments.CLOSED``) or the rows of ``growing.ROWS``.
    """
    rows = cut_lineage(closed)
    online = "kind" in rows.columns
    features = (_growing_features(rows, batch_id, folder) if online else judge.features(rows)).filter(F.col("len") >= MIN_POINTS)
    judged = cut_lineage(judge.judge(features))
    final = judged.filter("NOT provisional")
    log_verdicts(verdict_rows(final), f"{folder}/verdicts", batch_id)
    append_alerts(alert_rows(final, labels), f"{folder}/alerts", batch_id)
    shown = judged_rows(judged)
    log_verdicts(shown, f"{folder}/judged", batch_id)
    latest = latest_per_key(shown.select("channel", "ts", "value", "score", "severity", "provisional", "open_len"), ["channel"], ["ts", "provisional"])
    log_verdicts(latest, f"{folder}/scores", batch_id)
    late = rows.filter("kind = 'late'") if online else rows.limit(0)
    counts = judged.agg(F.count_if(~F.col("provisional")).alias("judged"), F.count_if("provisional").alias("previews"),
                        F.count_if(F.col("is_anomaly") & ~F.col("provisional")).alias("alerts"))
    log_verdicts(counts.crossJoin(late.agg(F.count(F.lit(1)).alias("late"))), f"{folder}/counters", batch_id)  # one row each


def start(judge: Judge, closed: DataFrame, folder: str, checkpoint: str, labels: DataFrame | None = None,
          interval: str | None = "500 milliseconds") -> StreamingQuery:
    """Streaming query from closed segments to the three stores; without an interval it drains what is there and stops."""
    writer = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, n: judge_batch(judge, df, n, folder, labels))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def publish_points(points: DataFrame, folder: str, checkpoint: str, interval: str | None = "500 milliseconds") -> StreamingQuery:
    """Points of each micro-batch by channel, for a display that follows the stream."""
    rows = points.select("channel", F.round(F.unix_micros("timestamp") / 1e6, 3).alias("ts"), "value")
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, n: log_verdicts(df, f"{folder}/points", n))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def unsent_segments(segmented: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Flush at the end of input: batch segments that the stream has not judged yet."""
    return segmented.join(verdicts.select(*keys).distinct(), keys, "left_anti")
