"""Dashboards, history and lookups. Verdict severity is in ``fusion.verdicts``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import severity as V
from tidemark.functions.text import shorten
from tidemark.operators.ordering import positions, tail_rows
from tidemark.operators.quantiles import quantiles

TAIL = 500
MAX_PAGE = 1000


def point_metrics(points: DataFrame) -> DataFrame:
    """Point-level rate and counts."""
    return points.agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum("anomaly").cast("long").alias("anomaly_rows"),
        F.round(F.coalesce(F.avg("anomaly"), F.lit(0.0)), 4).alias("point_anomaly_rate"))


def fault_count(scored: DataFrame, score: str = "anomaly_score") -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total_anomalies"), F.count_if(F.col(score) > V.FAULT).alias("fault_count"))


def anomaly_ratio(points: DataFrame, group: str = "channel") -> DataFrame:
    return points.groupBy(group).agg(
        F.sum("anomaly").cast("long").alias("anomalies"), F.count(F.lit(1)).alias("n"), F.avg("anomaly").alias("ratio"))


def class_counts(df: DataFrame, column: str, pivot: str | None = None, values: list[str] | None = None) -> DataFrame:
    if pivot is None:
        return df.groupBy(column).count()
    return df.groupBy(column).pivot(pivot, values).count().na.fill(0)


def sparkline(points: DataFrame, n: int = TAIL, quiet: list[str] | None = None, channels: DataFrame | None = None) -> DataFrame:
    """Last n points per channel as arrays, in-window positions of anomalies, rate and status; silent channels are offline."""
    last = tail_rows(points, ["channel"], ["timestamp", "seq"], n)
    packed = last.groupBy("channel").agg(
        F.sort_array(F.collect_list(F.struct("timestamp", "seq", "value", "anomaly"))).alias("_p"),
        F.avg("anomaly").alias("_rate"), F.count(F.lit(1)).alias("n_points"))
    marked = F.filter(F.transform("_p", lambda p, i: F.when(p["anomaly"] == 1, i)), lambda i: i.isNotNull())
    out = packed.select(
        "channel", "n_points", F.round("_rate", 4).alias("anomaly_rate"),
        V.by_rate(F.col("_rate"), F.col("channel"), quiet).alias("status"),
        F.transform("_p", lambda p: p["value"]).alias("values"), marked.alias("anomaly_positions"))
    if channels is None:
        return out
    return channels.select("channel").join(out, "channel", "left").withColumns({
        "n_points": F.coalesce("n_points", F.lit(0)), "anomaly_rate": F.coalesce("anomaly_rate", F.lit(0.0)),
        "status": F.coalesce("status", F.lit("offline"))})


def waveform(points: DataFrame, channel: str, segment: str | None = None, context: int = 200, tail: int = TAIL) -> DataFrame:
    """Rows around the middle row of the segment, else around the middle anomaly, else the last rows, with the band."""
    rows = positions(points.filter(F.col("channel") == channel), ["channel"], ["timestamp", "seq"])
    marks = rows.select(
        "pos", F.when(F.col("segment") == segment, 1).otherwise(2).alias("_kind") if segment is not None else F.lit(2).alias("_kind"),
        "anomaly").filter((F.col("_kind") == 1) | (F.col("anomaly") == 1))
    wanted = marks.groupBy("_kind").agg(F.count(F.lit(1)).alias("_n"))
    first = wanted.agg(F.min_by(F.struct("_kind", "_n"), "_kind").alias("k"))
    ranked = positions(marks.withColumn("_at", F.timestamp_micros("pos")), ["_kind"], ["pos"], ts="_at", pos="_i", total="_t")
    middle = ranked.join(F.broadcast(first), (F.col("_kind") == F.col("k._kind")) & (F.col("_i") == F.floor(F.col("k._n") / 2)))
    centre = middle.agg(F.max("pos").alias("_centre"))
    band = rows.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    near = rows.join(F.broadcast(centre)).filter(
        F.when(F.col("_centre").isNull(), F.col("pos") >= F.col("total") - tail)
        .otherwise((F.col("pos") >= F.col("_centre") - context) & (F.col("pos") < F.col("_centre") + context)))
    return near.join(F.broadcast(band)).select(
        "pos", "timestamp", "value", "anomaly", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        F.round(F.col("mean") + 3 * F.col("std"), 4).alias("upper_3sigma"), F.round(F.col("mean") - 3 * F.col("std"), 4).alias("lower_3sigma"))


def baseline_band(points: DataFrame) -> DataFrame:
    mean, std = F.avg("value"), F.stddev_samp("value")
    return points.groupBy("channel").agg(mean.alias("mean"), std.alias("std"), (mean + 3 * std).alias("upper_3sigma"),
                                         (mean - 3 * std).alias("lower_3sigma"))


def label_lookup(df: DataFrame, labels: DataFrame, key: str = "channel", out: str = "channel_label") -> DataFrame:
    """Display label by left join, the key itself where there is none."""
    return df.join(labels.select(key, F.col("label").alias(out)), key, "left").withColumn(out, F.coalesce(out, F.col(key)))


def alert_queue(scored: DataFrame, quiet: list[str] | None = None, limit: int = 120) -> DataFrame:
    """Entries above the fault threshold, worst first, with a shortened summary."""
    faults = scored.filter(F.col("anomaly_score") > V.FAULT)
    return faults.select(
        "segment", "channel", F.round("anomaly_score", 4).alias("anomaly_score"),
        V.by_score(F.col("anomaly_score"), F.col("channel"), quiet).alias("severity"),
        shorten(F.coalesce("explanation", F.lit("")), limit).alias("summary")).orderBy(F.desc("anomaly_score"), "segment")


def alert_totals(alerts: DataFrame) -> DataFrame:
    """Counts overall, by severity and by channel from one pass."""
    return alerts.groupingSets([[], ["severity"], ["channel"]], "severity", "channel").agg(F.count(F.lit(1)).alias("n"))


def filter_severity(alerts: DataFrame, severity: str | None) -> DataFrame:
    return alerts if severity in (None, "all") else alerts.filter(F.col("severity") == severity)


def alert_history(alerts: DataFrame, since: float | None = None, until: float | None = None, channel: str | None = None,
                  severity: str | None = None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page (newest first) and the total of all matches. The total is an aggregate of its own, so that
    the page stays a distributed top-n."""
    rows = alerts
    if since is not None:
        rows = rows.filter(F.col("ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("ts") <= until)
    if channel:
        rows = rows.filter(F.col("channel") == channel)
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    page = rows.orderBy(F.desc("ts"), F.desc("id")).offset(max(0, offset)).limit(max(1, min(limit, MAX_PAGE)))
    return page, rows.agg(F.count(F.lit(1)).alias("total"))


def payload_field(payload: Column, name: str, default: str = "") -> Column:
    """Field of a JSON text; bad JSON reads as empty."""
    return F.coalesce(F.get_json_object(payload, f"$.{name}"), F.lit(default))


def improvement(stages: DataFrame, order: str = "stage", value: str = "f1") -> DataFrame:
    """Relative change against the first stage, in percent, NULL for the first itself. Stages are a handful of rows."""
    base = F.first_value(value).over(W.orderBy(order))
    return stages.withColumn("base", base).withColumn(
        "improvement", F.when(F.row_number().over(W.orderBy(order)) > 1, (F.col(value) - F.col("base")) / F.col("base") * 100)).drop("base")


def durations(log: DataFrame, col: str) -> DataFrame:
    all_ = log.withColumn("_all", F.lit(1))
    rest = all_.groupBy("_all").agg(F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))
    return rest.join(quantiles(all_, ["_all"], col, {"median": 0.5}), "_all", "left").select("median", "mean", "min", "max")


def point_lookup(table: DataFrame, segment: str, channel: str, order: str) -> DataFrame:
    """First match in a fixed order."""
    return table.filter((F.col("segment") == segment) & (F.col("channel") == channel)).orderBy(order).limit(1)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key as one aggregate: the running best is merged before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*").select(*df.columns)


def known_channels(frames: DataFrame, channels: DataFrame) -> DataFrame:
    """Frames of known channels."""
    return frames.join(channels.select("channel"), "channel", "left_semi")


def ingest_counts(frames: DataFrame, channels: DataFrame) -> DataFrame:
    marked = frames.join(channels.select("channel", F.lit(True).alias("_k")), "channel", "left")
    return marked.agg(F.count("_k").alias("accepted"), F.count_if(F.col("_k").isNull()).alias("rejected"))


def channel_state(latest: DataFrame, channels: DataFrame, modelled: DataFrame | None = None) -> DataFrame:
    """Latest state per channel; a silent one is nominal and provisional.

    modelled: the channels that have a judge; given, the state says so and how long the open segment was when it was last seen.
    """
    state = latest_per_key(latest, ["channel"], ["ts"])
    full = channels.select("channel").join(state, "channel", "left").withColumns({
        "severity": F.coalesce("severity", F.lit("nominal")), "provisional": F.coalesce("provisional", F.lit(True))})
    if modelled is None:
        return full
    known = modelled.select("channel", F.lit("ready").alias("model")).distinct()
    return full.join(known, "channel", "left").withColumns({
        "model": F.coalesce("model", F.lit("unavailable")), "open_len": F.coalesce("open_len", F.lit(0)).cast("long")})


def run_counters(log: DataFrame) -> DataFrame:
    """Run-level query counters: queries, failures, mean times."""
    return log.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(~F.col("success")).alias("failures"),
        F.avg("retrieval_ms").alias("avg_retrieval_ms"), F.sum("retrieval_ms").alias("total_retrieval_ms"))


def scale_audit(features: DataFrame, columns: list[str], largest: int | None = None) -> DataFrame:
    """Mean, deviation, 1st and 99th percentile per feature and its scale over the smallest one."""
    from tidemark.operators.quantiles import quantiles
    from tidemark.operators.rules import long_form

    tall = long_form(features.withColumn("_all", F.lit("all")), ["_all"], columns)
    base = tall.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    cuts = quantiles(tall, ["feature"], "value", {"p01": 0.01, "p99": 0.99}, largest)
    joined = base.join(cuts, "feature")
    smallest = joined.agg(F.min(F.when(F.col("std") > 0, F.col("std"))).alias("_s"))
    return joined.join(F.broadcast(smallest)).withColumn("scale_ratio", F.col("std") / F.col("_s")).drop("_s")


def scaled(features: DataFrame, fit: DataFrame, columns: list[str], how: str = "robust", largest: int | None = None) -> DataFrame:
    """Features scaled by median and IQR, or mean and population deviation, of the fit rows only."""
    from tidemark.operators.quantiles import quantiles
    from tidemark.operators.rules import long_form

    tall = long_form(fit.withColumn("_all", F.lit("all")), ["_all"], columns)
    if how == "robust":
        cuts = quantiles(tall, ["feature"], "value", {"q1": 0.25, "centre": 0.5, "q3": 0.75}, largest)
        params = cuts.select("feature", "centre", (F.col("q3") - F.col("q1")).alias("spread"))
    else:
        params = tall.groupBy("feature").agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("spread"))
    entry = F.struct("centre", F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0).alias("spread"))
    packed = params.agg(F.map_from_entries(F.collect_list(F.struct("feature", entry))).alias("_m"))
    joined = features.join(F.broadcast(packed))
    return joined.withColumns({
        c: (F.col(c) - F.element_at("_m", F.lit(c))["centre"]) / F.element_at("_m", F.lit(c))["spread"] for c in columns}).drop("_m")
