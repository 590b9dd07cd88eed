"""Scans, segmentation, features, shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Entry
from tidemark.catalog import inputs as I
from tidemark.operators import features as X
from tidemark.operators import rules as R
from tidemark.operators import segments as G
from tidemark.schema import FEATURES, PEAK_FEATURES


def r6(df, *cols, places=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


def r6_sql(cols, places=6):
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols)


MOMENT_COLS = ["mean", "var", "std", "kurtosis", "skew"]
LATE = ["diff_var", "diff2_var", "var_div_duration", "var_div_len"]


def moments(spark, sf):
    d = X.moments(I.event_points(spark, sf), ["channel", "segment"])
    return r6(d.select("channel", "segment", "len", *MOMENT_COLS), *MOMENT_COLS)


def features_events(spark, sf):
    d = X.segment_features(I.event_points(spark, sf))
    d = d.select("channel", "segment", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return r6(d, *FEATURES)


def features_items(spark, sf):
    d = X.segment_features(I.item_points(spark, sf))
    d = d.select("channel", "segment", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return r6(d, *FEATURES)


def features_blocked(spark, sf):
    """Same result through the block path that very long segments take."""
    return r6(X.segment_features(I.event_points(spark, sf), block=32).select(
        "channel", "segment", *[F.col(c).cast("double").alias(c) for c in FEATURES]), *FEATURES)


FEATURES_SQL = "SELECT channel, segment, " + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in FEATURES) + " FROM plain JOIN peaks USING (segment)"


def gap_segments(spark, sf):
    d = G.segment_by_gap(I.user_points(spark, sf))
    d = d.groupBy("channel", "run").agg(F.count(F.lit(1)).alias("n_points"), F.sum("value").alias("total"),
                                        F.min("timestamp").cast("timestamp_ntz").alias("first_ts"),
                                        F.max("timestamp").cast("timestamp_ntz").alias("last_ts"))
    return r6(d, "total")


GAP_SQL = f"""{I.USER_POINTS}, g AS (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL OR
  (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 > greatest(3 * sampling, 5) THEN 1 ELSE 0 END AS opens
  FROM pts WINDOW w AS (PARTITION BY channel ORDER BY timestamp, seq)),
segs AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY channel ORDER BY timestamp, seq) AS BIGINT) AS run FROM g)"""


def live_labels(spark, sf):
    spans = G.segment_spans(G.segment_by_gap(I.user_points(spark, sf)), ["channel", "run"])
    d = G.live_labels(spans)
    return d.select("channel", "run", "seg_id", G.is_official(F.col("seg_id")).alias("official"))


def run_segments(spark, sf):
    """Declared ids in arrival order over users: the id is the event type, so ids come back."""
    pts = I.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("channel"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("segment"))
    d = G.segment_by_id(pts, "run")
    return d.groupBy("channel", "run").agg(F.min("segment").alias("segment"), F.count(F.lit(1)).alias("n_points"))


def mixed_segments(spark, sf):
    pts = I.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("channel"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"),
        F.lit(7200).alias("sampling"), F.when(F.col("event_type") == "click", F.dayofmonth("ts").cast("long")).alias("segment"))
    d = G.segment_mixed(pts)
    return d.groupBy("channel", "run").agg(F.max("open").alias("declared"), F.count(F.lit(1)).alias("n_points"))


MIXED_SQL = """WITH pts AS (SELECT CAST(user_id AS VARCHAR) AS channel, ts, event_id AS seq,
  CASE WHEN event_type = 'click' THEN CAST(day(ts) AS VARCHAR) END AS segment FROM events),
a AS (SELECT *, lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 21600 AS quiet FROM pts WINDOW w AS (PARTITION BY channel ORDER BY ts, seq)),
b AS (SELECT *, CASE WHEN segment IS NOT NULL THEN segment WHEN quiet THEN 'LIVE' END AS mark FROM a),
c AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY channel ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM b),
d AS (SELECT *, CASE WHEN open IS NULL THEN 1 WHEN segment IS NOT NULL THEN CAST(open IS DISTINCT FROM segment AS INTEGER) ELSE CAST(quiet AS INTEGER) END AS opens, coalesce(mark, open) AS held FROM c),
e AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY channel ORDER BY ts, seq) AS BIGINT) AS run FROM d)
SELECT channel, run, max(CASE WHEN held <> 'LIVE' THEN held END) AS declared, count(*) AS n_points FROM e GROUP BY 1, 2"""


def shape(spark, sf):
    d = X.segment_features(I.item_points(spark, sf))
    return d.select("segment", X.shape_class().alias("shape"), F.size(X.feature_summary()).cast("long").alias("summary_size"),
                    F.round(F.element_at(X.feature_summary(), F.lit("std")), 6).alias("summary_std"))


ENTRIES = [
    Entry("c05_moments", moments, f"WITH {I.EVENT_POINTS} SELECT channel, segment, count(*) AS len, round(avg(value), 6) AS mean, "
          f"round(var_pop(value), 6) AS var, round(stddev_pop(value), 6) AS std, round(kurtosis_pop(value), 6) AS kurtosis, round({I.SKEW_SQL}, 6) AS skew FROM pts GROUP BY ALL"),
    Entry("c04_features_events", features_events, f"WITH {I.EVENT_POINTS}, {I.PLAIN_SQL}, {I.PEAKS_SQL} {FEATURES_SQL}"),
    Entry("c08_features_items", features_items, f"WITH {I.ITEM_POINTS}, {I.PLAIN_SQL}, {I.PEAKS_SQL} {FEATURES_SQL}"),
    Entry("c08_features_blocked", features_blocked, f"WITH {I.EVENT_POINTS}, {I.PLAIN_SQL}, {I.PEAKS_SQL} {FEATURES_SQL}"),
    Entry("c01_run_segments", run_segments, """WITH g AS (SELECT CAST(user_id AS VARCHAR) AS channel, event_type AS segment, ts, event_id,
      CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY channel ORDER BY ts, event_id) AS BIGINT) AS run FROM g)
      SELECT channel, run, min(segment) AS segment, count(*) AS n_points FROM s GROUP BY 1, 2"""),
    Entry("c02_gap_segments", gap_segments, f"WITH {GAP_SQL} SELECT channel, run, count(*) AS n_points, round(sum(value), 6) AS total, "
          "min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM segs GROUP BY 1, 2"),
    Entry("c03_live_labels", live_labels, f"""WITH {GAP_SQL}, sp AS (SELECT channel, run, min(timestamp) AS f FROM segs GROUP BY 1, 2)
      SELECT channel, run, printf('LIVE-%04d', row_number() OVER (ORDER BY f, channel)) AS seg_id, false AS official FROM sp"""),
    Entry("j08_mixed_segments", mixed_segments, MIXED_SQL),
    Entry("c16_shape_class", shape, f"""WITH {I.ITEM_POINTS}, {I.PLAIN_SQL}, {I.PEAKS_SQL} SELECT segment, CASE WHEN n_peaks >= 3 AND diff_peaks <= 2 THEN 'intermittent_spikes'
      WHEN diff_peaks >= 10 THEN 'high_freq_jitter' WHEN n_peaks <= 1 AND diff2_peaks <= 5 THEN 'low_activity' ELSE 'unusual_shapes' END AS shape,
      9::BIGINT AS summary_size, round(std, 6) AS summary_std FROM plain JOIN peaks USING (segment)"""),
]
