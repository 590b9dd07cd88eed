"""Closed segments from a stream of points.

Closed segments carry ``channel, segment, official, sampling, provisional, values, clocks`` (microseconds).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.segments import gap_limit

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MIN_PREFIX_POINTS = 5

CLOSED = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("official", T.BooleanType()),
    T.StructField("sampling", T.IntegerType()),
    T.StructField("provisional", T.BooleanType()),
    T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("clocks", T.ArrayType(T.LongType())),
])


def _pack(grouped: GroupedData, segment: Column, official: bool) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(F.unix_micros("timestamp").alias("clock"), "seq", "value")))
    return grouped.agg(rows.alias("_r"), F.max("sampling").cast("int").alias("sampling")).select(
        "channel", segment.alias("segment"), F.lit(official).alias("official"), "sampling", F.lit(False).alias("provisional"),
        F.transform("_r", lambda r: r["value"]).alias("values"), F.transform("_r", lambda r: r["clock"]).alias("clocks"))


def gap_segments(points: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Gap rule as a session window per channel; a session closes when the watermark has passed its gap.

    The gap comes from the point before the silence; it equals the batch rule while a channel keeps its sampling.
    Points later than ``delay`` behind the newest time are dropped and counted by Spark as late rows.
    """
    gap = F.concat(gap_limit(F.col("sampling")).cast("string"), F.lit(" seconds"))
    grouped = points.withWatermark("timestamp", delay).groupBy("channel", F.session_window("timestamp", gap).alias("w"))
    label = F.concat(F.lit("LIVE-"), F.col("channel"), F.lit("-"), F.unix_micros("w.start").cast("string"))
    return _pack(grouped, label, False)


def declared_segments_by_watermark(points: DataFrame, delay: str = "1 minute", idle: str = "5 minutes") -> DataFrame:
    """Declared ids closed by silence. The key is (channel, id), so one busy channel spreads over many tasks."""
    grouped = points.withWatermark("timestamp", delay).groupBy(
        "channel", "segment", F.session_window("timestamp", idle).alias("w"))
    return _pack(grouped, F.col("segment").cast("string"), True)


class _OpenSegments(StatefulProcessor):
    """Per channel: the open segment. A point of another declared id, or an undeclared point after too long a silence,
    closes it; undeclared points without such a silence join whatever is open."""

    def __init__(self, preview: bool) -> None:
        self.preview = preview

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "segment string, official boolean, sampling int, last long")
        self.points = handle.getListState("points", "clock long, value double")

    def _row(self, channel: str, head: tuple, points: list, provisional: bool) -> dict:
        return {"channel": channel, "segment": head[0], "official": head[1], "sampling": head[2], "provisional": provisional,
                "values": [p[1] for p in points], "clocks": [p[0] for p in points]}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        channel = key[0]
        batch = pd.concat(list(rows)).sort_values(["clock", "seq"])
        head = self.head.get() if self.head.exists() else None
        fresh: list = []
        carried = head is not None
        closed: list[dict] = []
        for clock, segment, sampling, value in zip(batch["clock"], batch["segment"], batch["sampling"], batch["value"]):
            declared = segment is not None and segment == segment
            name = str(segment) if declared else f"LIVE-{channel}-{clock}"
            opens = head is None or (head[0] != name if declared else clock - head[3] > max(3 * sampling, 5) * 1_000_000)
            if opens and head is not None:
                kept = [tuple(p) for p in self.points.get()] if carried else []
                closed.append(self._row(channel, head, kept + fresh, False))
                fresh = []
                if carried:
                    self.points.clear()
                    carried = False
            if opens:
                head = (name, declared, int(sampling), int(clock))
            head = (head[0], head[1], head[2], int(clock))
            fresh.append((int(clock), float(value)))
        self.head.update(head)
        if fresh:
            self.points.appendList(fresh)
        if self.preview:
            prefix = [tuple(p) for p in self.points.get()]
            if len(prefix) >= MIN_PREFIX_POINTS:
                closed.append(self._row(channel, head, prefix, True))
        if closed:
            yield pd.DataFrame(closed)[CLOSED.names]

    def close(self) -> None:
        pass


def open_segments(points: DataFrame, preview: bool = False) -> DataFrame:
    """Segments closed on arrival of the next one, declared and undeclared mixed, as the points come in.

    Needs the RocksDB state store (``STATE_STORE``). Order matters here, so a channel is one key; use
    ``declared_segments_by_watermark`` for channels too busy for one task. With ``preview`` every batch also emits the
    growing segment of each touched channel, marked provisional; the trigger interval is the throttle.
    """
    rows = points.select(
        "channel", F.unix_micros("timestamp").alias("clock"), "seq", F.col("segment").cast("string").alias("segment"),
        F.col("sampling").cast("int").alias("sampling"), "value")
    return rows.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=_OpenSegments(preview), outputStructType=CLOSED, outputMode="Append", timeMode="None")


def to_points(closed: DataFrame) -> DataFrame:
    """Closed segments back to points, for the batch operators."""
    pairs = F.posexplode(F.arrays_zip("values", "clocks")).alias("seq", "p")
    return closed.select("channel", "segment", "sampling", F.get("clocks", F.lit(0)).alias("run"), pairs).select(
        "channel", "segment", "run", "sampling", F.timestamp_micros("p.clocks").alias("timestamp"), "seq", F.col("p.values").alias("value"))
