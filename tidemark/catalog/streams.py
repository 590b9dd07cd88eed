"""Queries that run Structured Streaming over the events: online features, flush and drop, late points, publication, the live store.

The events come as loads in time order, each a micro-batch or more, and commands as a last load.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tidemark.catalog import Entry
from tidemark.catalog import inputs as I
from tidemark.catalog.dashboards import scratch
from tidemark.operators import features as X
from tidemark.operators import rules as R
from tidemark.schema import FEATURES
from tidemark.session import cut_lineage
from tidemark.streaming import growing as G
from tidemark.streaming import judge as SJ
from tidemark.streaming import publish as P
from tidemark.streaming.segments import STATE_STORE

SETTING = "spark.sql.streaming.stateStore.providerClass"
DELAY = 3600


@contextmanager
def state_store(spark):
    """The state store that stateful operators in Python need, for the queries inside."""
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(SETTING) if before is None else spark.conf.set(SETTING, before)


def thirds(points):
    """The points as three loads in time order."""
    first, last = points.agg(F.min("timestamp"), F.max("timestamp")).first()
    step = (last - first) / 3
    at = F.col("timestamp")
    return [points.filter(at < F.lit(first + step)), points.filter((at >= F.lit(first + step)) & (at < F.lit(first + 2 * step))), points.filter(at >= F.lit(first + 2 * step))]


def commanded(points, drop=()):
    """One command a channel, after its last point: flush, or drop for the channels listed."""
    last = points.groupBy("channel").agg(F.max("timestamp").alias("timestamp"), F.max("seq").alias("seq"))
    return last.withColumn("command", F.when(F.col("channel").isin(*drop), G.DROP).otherwise(G.FLUSH))


def fed(spark, loads, start):
    """Runs the query that ``start`` makes of a stream over the loads until each is worked off."""
    folder = scratch(spark)
    schema = "channel string, timestamp timestamp, seq long, value double, sampling int, segment string, command string"
    names = [c.split()[0] for c in schema.split(", ")]
    with state_store(spark):
        for load in loads:
            given = load.columns
            kinds = dict(c.split() for c in schema.split(", "))
            load.select(*[(F.col(c) if c in given else F.lit(None)).cast(kinds[c]).alias(c) for c in names]).write.mode("append").parquet(f"{folder}/in")
            query = start(spark.readStream.schema(schema).parquet(f"{folder}/in"), folder)
            query.awaitTermination()
    return folder


def segment_rows(spark, loads, **options):
    """All rows that growing_segments gives of the loads."""
    def start(points, folder):
        writer = G.growing_segments(points, **options).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state")
        return writer.trigger(availableNow=True).format("parquet").start(f"{folder}/rows")
    folder = fed(spark, loads, start)
    return spark.read.schema(G.ROWS).parquet(f"{folder}/rows")


def growing_features(spark, sf):
    """All features of declared segments from the stream's small state, flushed at the end."""
    pts = I.event_points(spark, sf)
    rows = segment_rows(spark, [*thirds(pts), commanded(pts)], rounding="floor")
    f = G.statistics(rows, rows.filter("kind = 'swings'"), "floor")
    return f.select("channel", "segment", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURES])


FEATURES_SQL = f"{I.EVENT_POINTS}, {I.PLAIN_SQL}, {I.PEAKS_SQL}, f AS (SELECT * FROM plain JOIN peaks USING (segment))"
GROWING_SQL = f"WITH {FEATURES_SQL} SELECT channel, segment, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in FEATURES)} FROM f"


def flush_and_drop(spark, sf):
    """At the end every channel is flushed but one, whose open segment is given up."""
    pts = I.event_points(spark, sf)
    rows = segment_rows(spark, [*thirds(pts), commanded(pts, drop=("error",))])
    return rows.filter("kind IN ('closed', 'dropped')").select("channel", "segment", "kind", F.col("len").alias("n_points"), F.col("last_clock"))


FLUSH_SQL = f"""WITH {I.EVENT_POINTS}, s AS (SELECT channel, segment, count(*) AS n_points, max(epoch_us(timestamp)) AS last_clock FROM pts GROUP BY 1, 2)
SELECT *, CASE WHEN channel = 'error' AND last_clock = max(last_clock) OVER (PARTITION BY channel) THEN 'dropped' ELSE 'closed' END AS kind FROM s"""


def late_rows(spark, sf):
    """Two loads: every third event of the first half comes with the second; of these, what is an hour behind its channel's newest is late."""
    pts = I.event_points(spark, sf)
    first, last = pts.agg(F.min("timestamp"), F.max("timestamp")).first()
    now = (F.col("timestamp") < F.lit(first + (last - first) / 2)) & (F.col("seq") % 3 > 0)
    rows = segment_rows(spark, [pts.filter(now), pts.filter(~now), commanded(pts)], delay_seconds=DELAY)
    segments = rows.filter("kind = 'closed'").groupBy("channel", "segment").agg(F.sum("len").alias("n_points"), F.count(F.lit(1)).alias("runs"))
    late = rows.filter("kind = 'late'").groupBy("channel", "segment").agg(F.count(F.lit(1)).alias("n_late"), F.round(F.sum("last_value"), 6).alias("late_total"))
    return segments.join(late, ["channel", "segment"], "full").na.fill(0, ["n_points", "runs", "n_late"])


LATE_SQL = f"""WITH {I.EVENT_POINTS}, h AS (SELECT *, epoch_us(timestamp) AS c FROM pts), cut AS (SELECT min(c) + (max(c) - min(c)) // 2 AS half FROM h),
m AS (SELECT h.*, c < half AND seq % 3 > 0 AS now FROM h, cut), t AS (SELECT channel, max(c) AS newest FROM m WHERE now GROUP BY 1),
l AS (SELECT m.*, NOT now AND coalesce(c < newest - {DELAY}000000, false) AS late FROM m LEFT JOIN t USING (channel))
SELECT channel, segment, count(*) FILTER (NOT late) AS n_points, CAST(bool_or(NOT late) AS BIGINT) AS runs, count(*) FILTER (late) AS n_late, round(sum(value) FILTER (late), 6) AS late_total FROM l GROUP BY 1, 2"""


def _judged(spark, sf):
    pts = I.event_points(spark, sf)
    judge = SJ.Judge(cut_lineage(R.thresholds(cut_lineage(X.segment_features(pts)))))

    def start(points, folder):
        return SJ.start(judge, G.growing_segments(points, rounding="floor"), f"{folder}/out", f"{folder}/state", interval=None)
    return fed(spark, [*thirds(pts), commanded(pts)], start)


def publication(spark, sf):
    """Changes sent to a display: scores that differ from the channel's last one, and every alert once."""
    folder = _judged(spark, sf)
    with state_store(spark):
        P.start_publishing(spark, f"{folder}/out", f"{folder}/publishing", interval=None).awaitTermination()
    return spark.read.parquet(f"{folder}/out/changes").select("channel", "number", "kind", "segment", "score", "severity", F.round("value", 6).alias("value"))


VERDICTS_SQL = f"""{FEATURES_SQL}, {I.thresholds_sql('f', 'lim', FEATURES)}, k AS (SELECT * FROM f WHERE len >= 3), {I.hits_sql('k', 'lim', 'h', FEATURES, 'test')},
lastv AS (SELECT segment, arg_max(value, (epoch_us(timestamp), seq)) AS value FROM pts GROUP BY 1),
v AS (SELECT channel, segment, h.last_ts AS ended, h.hits::DOUBLE AS score, hits >= 2 AS is_anomaly, lastv.value,
  CASE WHEN hits < 2 THEN 'nominal' WHEN hits >= 4 THEN 'critical' WHEN hits = 3 THEN 'warning' ELSE 'caution' END AS severity FROM h JOIN lastv USING (segment))"""
PUBLICATION_SQL = f"""WITH {VERDICTS_SQL}, c AS (SELECT *, lag(score) OVER w IS NULL OR lag(score) OVER w <> score OR lag(severity) OVER w <> severity AS changed FROM v WINDOW w AS (PARTITION BY channel ORDER BY ended)),
e AS (SELECT *, 'score' AS kind FROM c WHERE changed UNION ALL SELECT *, 'alert' FROM c WHERE is_anomaly)
SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY ended, kind DESC) AS number, kind, segment, score, severity, round(value, 6) AS value FROM e"""


def stream_state(spark, sf):
    """State per channel from the stores that the judged stream has written, one channel silent and without a judge."""
    from tidemark.operators import reports as D

    folder = _judged(spark, sf)
    scores = spark.read.parquet(f"{folder}/out/scores")
    channels = I.event_points(spark, sf).select("channel").distinct()
    every = channels.union(spark.range(1).select(F.lit("silent").alias("channel")))
    return D.channel_state(scores, every, channels).select("channel", F.round("ts", 6).alias("ts"), F.round("value", 6).alias("value"), "score", "severity", "provisional", "model", "open_len")


STATE_SQL = f"""WITH {VERDICTS_SQL} SELECT channel, round(epoch_us(ended) / 1e6, 6) AS ts, round(value, 6) AS value, score, severity, false AS provisional, 'ready' AS model, 0::BIGINT AS open_len
FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ended DESC) AS r FROM v) WHERE r = 1 UNION ALL SELECT 'silent', NULL, NULL, NULL, 'nominal', true, 'unavailable', 0"""


def retention(spark, sf):
    """The live store after all micro-batches: the last 500 points of every channel and the newest alert (a value over 100) of every segment."""
    def start(points, folder):
        def keep(batch, n):
            rows = cut_lineage(batch.filter("value IS NOT NULL"))
            alerts = rows.filter("value > 100").select("channel", "segment", F.struct("timestamp", "seq").alias("ts"), "value")
            P.retain(rows.select("channel", "timestamp", "seq", "value"), alerts, f"{folder}/live", n)
        writer = points.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(keep)
        return writer.trigger(availableNow=True).start()
    folder = fed(spark, thirds(I.event_points(spark, sf)), start)
    points, alerts = (P.live_store(spark, f"{folder}/live", name) for name in ("points", "alerts"))
    none = F.lit(None).cast("string").alias("segment")
    return points.select(F.lit("point").alias("kind"), "channel", none, "seq", "value").unionByName(
        alerts.select(F.lit("alert").alias("kind"), "channel", "segment", F.col("ts.seq").alias("seq"), "value"))


RETENTION_SQL = f"""WITH {I.EVENT_POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY timestamp DESC, seq DESC) AS k FROM pts),
a AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY timestamp DESC, seq DESC) AS k FROM pts WHERE value > 100)
SELECT 'point' AS kind, channel, NULL AS segment, seq, value FROM r WHERE k <= 500 UNION ALL SELECT 'alert', channel, segment, seq, value FROM a WHERE k = 1"""

ENTRIES = [
    Entry("b09_publication", publication, PUBLICATION_SQL),
    Entry("b10_retention", retention, RETENTION_SQL),
    Entry("j01_growing_features", growing_features, GROWING_SQL),
    Entry("j02_flush_and_drop", flush_and_drop, FLUSH_SQL),
    Entry("j05_stream_state", stream_state, STATE_SQL),
    Entry("j09_late_rows", late_rows, LATE_SQL),
]
