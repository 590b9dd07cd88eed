"""What a display that follows the stream is sent and keeps: changes per channel, and a bounded live store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators.ordering import tail_rows
from tidemark.operators.reports import latest_per_key
from tidemark.sinks.tables import log_verdicts

JUDGED = ("channel string, segment string, run long, ts double, value double, score double, severity string, provisional boolean, is_anomaly boolean, "
          "open_len long, batch long")
CHANGES = "channel string, number long, kind string, segment string, run long, ts double, value double, score double, severity string, provisional boolean"
MAX_POINTS = 500


class _Changes(StatefulProcessor):
    """Per channel: the score that was sent last, and the segments whose alert was sent."""

    def __init__(self, remember: int | None):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "score double, severity string, provisional boolean, number long")
        self.sent = handle.getMapState("sent", "segment string, run long", "number long", self.remember)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "provisional", "run"], kind="stable")
        last = tuple(self.last.get()) if self.last.exists() else (None, None, None, 0)
        number, out = last[3], []
        for r in batch.itertuples(index=False):
            told = (r.segment, r.run, r.ts, r.value, r.score, r.severity, r.provisional)
            shown = (r.score, r.severity, bool(r.provisional))
            if shown != last[:3]:
                number += 1
                out.append((key[0], number, "score", *told))
                last = shown
            if r.is_anomaly and not r.provisional and not self.sent.containsKey((r.segment, r.run)):
                number += 1
                out.append((key[0], number, "alert", *told))
                self.sent.updateValue((r.segment, r.run), (number,))
        self.last.update((*last[:3], number))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def changes(judged: DataFrame, remember_seconds: float | None = None) -> DataFrame:
    """From a stream of judged segments (``JUDGED``): scores that differ from the channel's last one, and every alert once.

    Changes are numbered per channel. They come from state alone, no store is read again; a judged row that comes twice changes nothing.
    remember_seconds: how long a sent alert is remembered; None remembers it always.
    """
    remember = None if remember_seconds is None else round(remember_seconds * 1e3)
    return judged.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=_Changes(remember), outputStructType=CHANGES, outputMode="Append", timeMode="None" if remember is None else "ProcessingTime")


def start_publishing(spark: SparkSession, folder: str, checkpoint: str, interval: str | None = "500 milliseconds") -> StreamingQuery:
    """Follows the judged segments of ``folder`` and writes the changes of each micro-batch as a partition that a retry replaces."""
    judged = spark.readStream.schema(JUDGED).option("recursiveFileLookup", "true").parquet(f"{folder}/judged")
    writer = changes(judged).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, n: log_verdicts(df, f"{folder}/changes", n))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def retain(points: DataFrame, alerts: DataFrame, folder: str, batch_id: int, keep: int = MAX_POINTS) -> None:
    """The live store after one more micro-batch: the last ``keep`` points of every channel, the newest alert of every segment.

    points: channel, timestamp, seq and more; alerts: channel, segment, ts and more. A batch is reduced by itself before it meets what
    was kept, which is no more than ``keep`` points a channel. Every batch writes a version of its own from the version before, so a retry
    gives the same; the version before that is removed.
    """
    spark = points.sparkSession
    for name, fresh, reduce in (
            ("points", points, lambda d: tail_rows(d, ["channel"], ["timestamp", "seq"], keep).drop("rank_desc")),
            ("alerts", alerts, lambda d: latest_per_key(d, ["channel", "segment"], ["ts"]))):
        before, now = f"{folder}/{name}/v={batch_id - 1}", f"{folder}/{name}/v={batch_id}"
        rows = reduce(fresh)
        if batch_id > 0:
            rows = reduce(rows.unionByName(spark.read.schema(fresh.schema).parquet(before)))
        rows.write.mode("overwrite").parquet(now)
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/v={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def live_store(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``points`` or ``alerts`` of the newest version."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [s.getPath() for s in files.listStatus(place) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(versions, key=lambda p: int(p.getName().split("=")[1])).toString())
