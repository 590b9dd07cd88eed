"""How the driver's tables stand in for telemetry, corpora and queries, in Spark and in SQL.

There are no anomaly labels in the tables. A segment is labelled when its largest value is in the top fifth
of its channel; such labels check the plumbing, not detection quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.hashing import uniform
from tidemark.operators.features import derived, moments, segment_features, step_features, with_steps
from tidemark.operators.quantiles import quantiles
from tidemark.operators.sampling import stratified_split
from tidemark.schema import FEATURES, PEAK_FEATURES
from tidemark.session import cut_lineage

PLAIN = [f for f in FEATURES if f not in PEAK_FEATURES]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Times in the files carry no zone; they are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    for c, t in df.dtypes:
        if t == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return spread(df) if name in ("documents", "pages") else df


def spread(df: DataFrame) -> DataFrame:
    """Texts of a file with fewer splits than cores are dealt out before regular expressions run over them.

    A corpus of many splits is left as it is, so nothing is shuffled where it would cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Feature cache: the segment tables are computed once per application and read back by later queries."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = cut_lineage(build())
    return _STORED[key]


def event_points(spark: SparkSession, sf: str) -> DataFrame:
    """Declared segments: channel = event type, segment = event type and day."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("channel"), F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"),
        "value", F.lit(1).alias("sampling"),
        F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMdd")).alias("segment"))


def user_points(spark: SparkSession, sf: str) -> DataFrame:
    """Undeclared segments: channel = user, eight hours of sampling, so a day of silence cuts."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("channel"), F.col("ts").alias("timestamp"),
        F.col("event_id").alias("seq"), "value", F.lit(28800).alias("sampling"))


def item_points(spark: SparkSession, sf: str) -> DataFrame:
    """Many segments per channel: channel = flag and status, segment = channel and supplier.

    Prices are divided by a prime, so that means do not end exactly on a rounding boundary of the comparison.
    """
    channel = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf, "lineitem").select(
        channel.alias("channel"), F.col("l_shipdate").alias("timestamp"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_extendedprice") / 1009.0).alias("value"), F.lit(5).alias("sampling"),
        F.concat_ws("-", channel, F.col("l_suppkey").cast("string")).alias("segment"))


EVENT_POINTS = """pts AS (SELECT event_type AS channel, ts AS timestamp, event_id AS seq, value, 1 AS sampling,
  event_type || '-' || strftime(ts, '%Y%m%d') AS segment FROM events)"""
USER_POINTS = """pts AS (SELECT CAST(user_id AS VARCHAR) AS channel, ts AS timestamp, event_id AS seq, value,
  28800 AS sampling FROM events)"""
ITEM_POINTS = """pts AS (SELECT l_returnflag || l_linestatus AS channel, l_shipdate AS timestamp,
  l_orderkey * 10 + l_linenumber AS seq, l_extendedprice / 1009.0 AS value, 5 AS sampling,
  l_returnflag || l_linestatus || '-' || CAST(l_suppkey AS VARCHAR) AS segment FROM lineitem)"""


def u_sql(key: str, seed: object) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '#' || '{seed}'), 1, 8) AS BIGINT) / 4294967296.0)"


def u_sql_tag(key: str, tag: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '#' || {tag}), 1, 8) AS BIGINT) / 4294967296.0)"


SKEW_SQL = """CASE WHEN var_pop(value) > 0 THEN (avg(value*value*value) - 3*avg(value)*avg(value*value) + 2*avg(value)*avg(value)*avg(value))
  / (var_pop(value) * stddev_pop(value)) END"""

# Segment features without the peak counts, from a relation pts(channel, segment, timestamp, seq, value, sampling).
PLAIN_SQL = f"""lagged AS (SELECT *, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 1e6 AS gap, value - lag(value) OVER w AS d1
  FROM pts WINDOW w AS (PARTITION BY channel, segment ORDER BY timestamp, seq)),
lagged2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY channel, segment ORDER BY timestamp, seq) AS d2 FROM lagged),
stats AS (SELECT channel, segment, CAST(max(sampling) AS INTEGER) AS sampling,
  min(timestamp) AS first_ts, max(timestamp) AS last_ts, max(value) AS top,
  (CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) AS BIGINT) % 86400)::DOUBLE AS duration,
  count(*) AS len, avg(value) AS mean, var_pop(value) AS var, stddev_pop(value) AS std,
  kurtosis_pop(value) AS kurtosis, {SKEW_SQL} AS skew, var_pop(d1) AS diff_var, var_pop(d2) AS diff2_var,
  coalesce(sum(((CAST(floor(gap) AS BIGINT) % 86400)::DOUBLE) ** 2), 0.0) AS gaps_squared
  FROM lagged2 GROUP BY ALL),
plain AS (SELECT *, sampling::DOUBLE * len AS len_weighted,
  CASE WHEN duration > 0 THEN var / duration ELSE 0.0 END AS var_div_duration, var / len AS var_div_len FROM stats)"""

# Peak counts by definition: every local maximum against every sample of its series.
PEAKS_SQL = """placed AS (SELECT segment, value, row_number() OVER (PARTITION BY segment ORDER BY timestamp, seq) - 1 AS i,
  count(*) OVER (PARTITION BY segment) AS n FROM pts),
width(k) AS (VALUES (10), (20)),
slots AS (SELECT segment, n, k, unnest(range(greatest(n, k))) AS j FROM (SELECT DISTINCT segment, n FROM placed), width),
series AS (
  SELECT segment, 'n_peaks' AS s, i, value AS x FROM placed
  UNION ALL SELECT a.segment, 'diff_peaks', a.i, b.value - a.value FROM placed a JOIN placed b ON a.segment = b.segment AND b.i = a.i + 1
  UNION ALL SELECT a.segment, 'diff2_peaks', a.i, (c.value - b.value) - (b.value - a.value) FROM placed a
    JOIN placed b ON a.segment = b.segment AND b.i = a.i + 1 JOIN placed c ON a.segment = c.segment AND c.i = a.i + 2
  UNION ALL SELECT t.segment, 'smooth' || k || '_n_peaks', j, coalesce(sum(p.value), 0.0) / k FROM slots t
    LEFT JOIN placed p ON p.segment = t.segment AND p.i BETWEEN j + (least(t.n, k) - 1) // 2 - k + 1 AND j + (least(t.n, k) - 1) // 2
    GROUP BY t.segment, k, j),
need AS (SELECT segment, s, 0.1 * (max(x) - min(x)) AS p FROM series GROUP BY ALL),
edge AS (SELECT *, lag(x) OVER (PARTITION BY segment, s ORDER BY i) AS before FROM series),
runs AS (SELECT segment, s, x, row_number() OVER (PARTITION BY segment, s ORDER BY i) AS j FROM edge WHERE before IS NULL OR before <> x),
tops AS (SELECT * FROM (SELECT *, lag(x) OVER w AS l, lead(x) OVER w AS r FROM runs WINDOW w AS (PARTITION BY segment, s ORDER BY j)) WHERE l < x AND r < x),
walls AS (SELECT t.segment, t.s, t.j, t.x, max(r.j) FILTER (r.j < t.j AND r.x > t.x) AS lj, min(r.j) FILTER (r.j > t.j AND r.x > t.x) AS rj
  FROM tops t JOIN runs r ON r.segment = t.segment AND r.s = t.s GROUP BY ALL),
bases AS (SELECT w.segment, w.s, w.j, w.x, min(r.x) FILTER (r.j < w.j AND r.j > coalesce(lj, -1)) AS lmin,
  min(r.x) FILTER (r.j > w.j AND r.j < coalesce(rj, 1000000000)) AS rmin
  FROM walls w JOIN runs r ON r.segment = w.segment AND r.s = w.s GROUP BY w.segment, w.s, w.j, w.x),
found AS (SELECT b.segment, b.s, count(*) AS c FROM bases b JOIN need USING (segment, s) WHERE b.x - greatest(lmin, rmin) >= p GROUP BY ALL),
peaks AS (SELECT segment, coalesce(sum(c) FILTER (s = 'n_peaks'), 0)::BIGINT AS n_peaks,
  coalesce(sum(c) FILTER (s = 'smooth10_n_peaks'), 0)::BIGINT AS smooth10_n_peaks, coalesce(sum(c) FILTER (s = 'smooth20_n_peaks'), 0)::BIGINT AS smooth20_n_peaks,
  coalesce(sum(c) FILTER (s = 'diff_peaks'), 0)::BIGINT AS diff_peaks, coalesce(sum(c) FILTER (s = 'diff2_peaks'), 0)::BIGINT AS diff2_peaks
  FROM (SELECT DISTINCT segment FROM placed) LEFT JOIN found USING (segment) GROUP BY segment)"""


def plain_features(points: DataFrame) -> DataFrame:
    """Features without peak counts: the points are dealt out and ordered once for the window pass, and the moments are taken where they then lie."""
    keys = ["channel", "segment"]
    named = points.filter(F.col("channel").isNotNull() & F.col("segment").isNotNull())
    first = F.row_number().over(W.partitionBy(*keys).orderBy("timestamp", "seq")) == 1
    # read from the first point as it lies: the least (timestamp, seq) by an aggregate would keep rows from being hashed
    stepped = with_steps(named, keys).withColumn("_sampling", F.when(first, F.col("sampling"))).drop("sampling")
    return derived(moments(stepped, keys, [F.max("_sampling").alias("sampling"), F.max("value").alias("top"), *step_features()]))


def labelled(features: DataFrame, largest: int | None = None) -> DataFrame:
    """Synthetic label and split: top fifth of the channel; 70 % train, a fifth of it for validation."""
    cut = quantiles(features, ["channel"], "top", {"cut": 0.8}, largest)
    tagged = features.join(cut, "channel").withColumn("anomaly", (F.col("top") >= F.col("cut")).cast("int")).withColumn(
        "train", (uniform(F.col("segment"), "train") < 0.7).cast("int")).drop("cut")
    return stratified_split(tagged, "segment", largest=largest)


LABELLED_SQL = f"""tagged AS (SELECT p.*, CAST(top >= cut AS INTEGER) AS anomaly, CAST({u_sql('segment', 'train')} < 0.7 AS INTEGER) AS train,
  {u_sql('segment', 42)} AS _u FROM whole p JOIN (SELECT channel, quantile_cont(top, 0.8) AS cut FROM whole GROUP BY 1) USING (channel)),
labelled AS (SELECT t.* EXCLUDE (_u), CASE WHEN train = 0 THEN 'test' WHEN _u <= vcut THEN 'val' ELSE 'fit' END AS split
  FROM tagged t LEFT JOIN (SELECT anomaly, train, quantile_cont(_u, 0.2) AS vcut FROM tagged WHERE train = 1 GROUP BY 1, 2) USING (anomaly, train))"""


def item_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Item segments with all 18 features, label and split."""
    points = item_points(spark, sf)
    plain = cut_lineage(plain_features(points))
    longest = plain.agg(F.max("len")).first()[0] or 0
    peaks = segment_features(points, longest=longest).select("channel", "segment", *PEAK_FEATURES)
    return labelled(cut_lineage(plain.join(peaks, ["channel", "segment"])))


WHOLE_SQL = f"{PLAIN_SQL}, {PEAKS_SQL}, whole AS (SELECT * FROM plain JOIN peaks USING (segment))"
ITEM_SEGMENTS = f"{ITEM_POINTS}, {WHOLE_SQL}, {LABELLED_SQL}"


def thresholds_sql(source: str, out: str, columns: list[str]) -> str:
    cols = ", ".join(columns)
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"""{out}_tall AS (UNPIVOT (SELECT channel, {casts} FROM {source}) ON {cols} INTO NAME feature VALUE value),
{out} AS (SELECT channel, feature, count(value) AS n, avg(value) AS mean,
  CASE WHEN stddev_samp(value) > 1e-6 THEN stddev_samp(value) ELSE 1.0 END AS std,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
  FROM {out}_tall GROUP BY ALL HAVING count(value) >= 5)"""


def hits_sql(source: str, limits: str, out: str, columns: list[str], mode: str = "feature", keep: str = "*") -> str:
    cols = ", ".join(columns)
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    sigma, iqr = "abs(value - t.mean) > 3.0 * t.std", "(value < t.q1 - 1.5 * t.iqr OR value > t.q3 + 1.5 * t.iqr)"
    fired = f"CAST(({sigma}) OR {iqr} AS INTEGER)" if mode == "feature" else f"CAST({sigma} AS INTEGER) + CAST({iqr} AS INTEGER)"
    return f"""{out}_tall AS (UNPIVOT (SELECT channel, segment, {casts} FROM {source}) ON {cols} INTO NAME feature VALUE value),
{out}_n AS (SELECT segment, sum({fired})::BIGINT AS hits, count(*) AS judged FROM {out}_tall v JOIN {limits} t USING (channel, feature) GROUP BY 1),
{out} AS (SELECT s.{keep}, coalesce(hits, 0)::BIGINT AS hits, coalesce(judged, 0)::BIGINT AS judged FROM {source} s LEFT JOIN {out}_n USING (segment))"""
