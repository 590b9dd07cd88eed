"""Cutting point streams into segments.

Points: ``channel, timestamp, seq, value, sampling[, segment, anomaly, train]``; ``seq`` breaks ties in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordering import carry_forward, run_numbers

ORDER = ["timestamp", "seq"]


def gap_limit(sampling: Column) -> Column:
    """Longest silence inside a segment, in seconds."""
    return F.greatest(F.lit(3) * sampling, F.lit(5))


def segment_by_id(points: DataFrame, mode: str = "group", seconds: int | None = None) -> DataFrame:
    """Declared ids. ``group``: one segment per id; ``run``: an id that comes back opens a second run."""
    if mode == "group":
        return points.withColumn("run", F.lit(1).cast("long"))
    numbered = run_numbers(
        points, ["channel"], ORDER, ["segment"],
        lambda prev, cur: ~prev["segment"].eqNullSafe(cur["segment"]), seconds=seconds)
    return numbered


def segment_by_gap(points: DataFrame, seconds: int | None = None) -> DataFrame:
    """A new segment when the silence before a point exceeds the limit of the incoming point."""
    def starts(prev: Column, cur: Column) -> Column:
        silence = (F.unix_micros(cur["timestamp"]) - F.unix_micros(prev["timestamp"])) / F.lit(1e6)
        return silence > gap_limit(cur["sampling"])

    return run_numbers(points, ["channel"], ORDER, ["timestamp", "sampling"], starts, seconds=seconds)


def segment_mixed(points: DataFrame, seconds: int | None = None) -> DataFrame:
    """Declared id where present, gap rule otherwise.

    A declared id that differs from the open segment closes it; points without an id stay in the
    open segment, whatever its kind, until the gap rule fires. ``open`` is the declared id of the run, if any.
    """
    d = carry_forward(points.withColumn("_at", F.col("timestamp")), ["channel"], ORDER, "_at", "_before", seconds)
    silence = (F.unix_micros("timestamp") - F.unix_micros("_before")) / F.lit(1e6)
    quiet = F.col("_before").isNull() | (silence > gap_limit(F.col("sampling")))
    d = d.withColumn("_mark", F.when(F.col("segment").isNotNull(), F.col("segment").cast("string"))
                     .when(quiet, F.lit("LIVE")))
    d = carry_forward(d, ["channel"], ORDER, "_mark", "_declared", seconds)
    d = d.withColumn("_flag", F.when(F.col("segment").isNotNull(),
                                     ~F.col("_declared").eqNullSafe(F.col("segment").cast("string"))).otherwise(quiet))
    d = run_numbers(d, ["channel"], ORDER, ["_flag"], lambda _, cur: cur["_flag"], seconds=seconds)
    held = F.coalesce(F.col("_mark"), F.col("_declared"))
    return d.withColumn("open", F.when(held != "LIVE", held)).drop("_at", "_before", "_mark", "_declared", "_flag")


def segment_spans(segmented: DataFrame, keys: list[str]) -> DataFrame:
    """One row per segment: first and last time, number of points."""
    return segmented.groupBy(*keys).agg(
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.count(F.lit(1)).alias("n_points"))


def live_labels(spans: DataFrame) -> DataFrame:
    """``LIVE-0001`` and so on by (first time, channel); declared segments are the official ones.

    The running number is global, so it is built from per-hour counts and never sorts all segments in one task.
    """
    hour = F.floor(F.unix_micros("first_ts") / F.lit(3_600_000_000))
    cut = spans.withColumn("_hour", hour)
    per_hour = cut.groupBy("_hour").agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_hour.groupBy(F.floor(F.col("_hour") / 24).alias("_day")).agg(F.sum("_n").alias("_n"))
    days = per_day.withColumn("_day_before", F.sum("_n").over(W.orderBy("_day")) - F.col("_n")).drop("_n")
    hours = (
        per_hour.withColumn("_day", F.floor(F.col("_hour") / 24))
        .withColumn("_in_day", F.sum("_n").over(W.partitionBy("_day").orderBy("_hour")) - F.col("_n"))
        .join(days, "_day")
        .select("_hour", (F.col("_day_before") + F.col("_in_day")).alias("_before"))
    )
    numbered = cut.withColumn(
        "_at", F.row_number().over(W.partitionBy("_hour").orderBy("first_ts", "channel"))
    ).join(hours, "_hour")
    number = F.col("_before") + F.col("_at")
    return (
        numbered.withColumn("live_no", number)
        .withColumn("seg_id", F.format_string("LIVE-%04d", number))
        .withColumn("official", F.lit(False))
        .drop("_hour", "_at", "_before")
    )


def is_official(seg_id: Column) -> Column:
    return ~F.startswith(seg_id, F.lit("LIVE-"))
