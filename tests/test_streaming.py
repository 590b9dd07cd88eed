from pyspark.sql import functions as F

from tidemark.operators.features import segment_features
from tidemark.operators.segments import segment_by_gap, segment_by_id, segment_mixed
from tidemark.sinks.tables import current_verdicts
from tidemark.streaming import judge as J
from tidemark.streaming import segments as S

SCHEMA = "channel string, timestamp timestamp, seq long, value double, sampling int, segment string"


def points(spark):
    """Two channels, 40 segments each, cut by silence and by declared id alike; some values stand out."""
    d = spark.range(2 * 40 * 12).select(
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("channel"), F.floor(F.col("id") / 2).alias("i"), F.col("id").alias("seq"))
    seg = F.floor(F.col("i") / 12)
    wave = F.sin(F.col("i") * 0.9) + F.when((seg % 13 == 5) & (F.col("i") % 12 == 6), 40.0).otherwise(0.0) + F.pmod(F.col("i") * 7, F.lit(11)) / 10
    return d.select(
        "channel", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i") + seg * 60).alias("timestamp"), "seq", wave.alias("value"),
        F.lit(1).alias("sampling"), seg.cast("string").alias("segment"))


def feed(spark, folder, parts=3):
    """The points as files, in time order."""
    d = points(spark).withColumn("part", F.ntile(parts).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("timestamp", "seq")))
    for n in range(1, parts + 1):
        d.filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(folder + "/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder + "/in")


def judge_of(spark):
    f = segment_features(segment_by_id(points(spark))).withColumn("train", F.lit(1))
    return J.Judge.train(f, ["A"], trees=20, psi=32)


def test_declared_stream_equals_batch(spark, folder):
    judge = judge_of(spark)
    q = J.start(judge, S.open_segments(feed(spark, folder)), folder + "/out", folder + "/cp", interval=None)
    q.awaitTermination(240)
    assert q.exception() is None
    got = current_verdicts(spark, folder + "/out/verdicts").select("channel", "segment", "is_anomaly", "severity", "n_points")
    batch = judge.judge(segment_features(points(spark), rounding="round").filter("len >= 3"))
    want = J.verdict_rows(batch).select("channel", "segment", "is_anomaly", "severity", "n_points")
    rows = got.collect()
    assert len(rows) == 78  # the last segment of each channel stays open
    assert got.exceptAll(want).count() == 0
    left = J.unsent_segments(want, got, ["channel", "segment"]).collect()
    assert sorted((r.channel, r.segment) for r in left) == [("A", "39"), ("B", "39")]
    alerts = spark.read.parquet(folder + "/out/alerts")
    assert alerts.count() == want.filter("is_anomaly = 1 AND segment <> '39'").count() > 0
    assert spark.read.parquet(folder + "/out/counters").agg(F.sum("judged")).first()[0] == 78


def test_gap_stream_equals_batch(spark, folder):
    judge = judge_of(spark)
    undeclared = feed(spark, folder).drop("segment")
    q = J.start(judge, S.gap_segments(undeclared, "1 second"), folder + "/out", folder + "/cp", interval=None)
    q.awaitTermination(240)
    got = current_verdicts(spark, folder + "/out/verdicts")
    runs = segment_by_gap(points(spark).drop("segment")).groupBy("channel", "run").agg(
        F.max("timestamp").alias("t"), F.count(F.lit(1)).alias("n_points"))
    want = runs.select("channel", (F.unix_micros("t") / 1e6).alias("ts"), "n_points")
    assert got.count() >= 70
    assert got.select("channel", "ts", "n_points").exceptAll(want).count() == 0


def test_preview_is_never_an_alert(spark, folder):
    judge = judge_of(spark)
    q = J.start(judge, S.open_segments(feed(spark, folder, 2), preview=True), folder + "/out", folder + "/cp", interval=None)
    q.awaitTermination(240)
    counters = spark.read.parquet(folder + "/out/counters").agg(F.sum("judged"), F.sum("previews")).first()
    assert counters[0] == 78 and counters[1] >= 2
    assert current_verdicts(spark, folder + "/out/verdicts").count() == 78


def test_points_are_published(spark, folder):
    q = J.publish_points(feed(spark, folder), folder + "/out", folder + "/cp", interval=None)
    q.awaitTermination(240)
    assert spark.read.parquet(folder + "/out/points").count() == 960


def test_declared_by_watermark(spark, folder):
    closed = S.declared_segments_by_watermark(feed(spark, folder), "1 second", "20 seconds")
    q = closed.writeStream.format("memory").queryName("closed").trigger(availableNow=True).option("checkpointLocation", folder + "/cp").start()
    q.awaitTermination(240)
    rows = spark.sql("SELECT channel, segment, size(values) AS n FROM closed").collect()
    assert len(rows) >= 70 and all(r.n == 12 for r in rows)


def test_segment_rules(spark):
    rows = [("A", 0, 1, None), ("A", 5, 1, None), ("A", 11, 1, None), ("A", 12, 1, "7"), ("A", 13, 1, None), ("A", 30, 1, "7"),
            ("A", 31, 1, "8"), ("A", 50, 1, None)]
    d = spark.createDataFrame([(c, t, s, g, i) for i, (c, t, s, g) in enumerate(rows)], "channel string, t long, sampling int, segment string, seq long")
    d = d.withColumn("timestamp", F.timestamp_seconds("t")).withColumn("value", F.lit(1.0))
    gap = segment_by_gap(d.filter("seq < 3"))
    assert [r.run for r in gap.orderBy("seq").collect()] == [1, 1, 2]
    for width in (3, 10_000):
        mixed = segment_mixed(d, seconds=width)
        assert [r.run for r in mixed.orderBy("seq").collect()] == [1, 1, 2, 3, 3, 3, 4, 5]
        assert [r.open for r in mixed.orderBy("seq").collect()] == [None, None, None, "7", "7", "7", "8", None]
    runs = segment_by_id(d.filter("segment IS NOT NULL"), "run", seconds=2)
    assert [r.run for r in runs.orderBy("seq").collect()] == [1, 1, 2]


def test_a_returning_id_is_a_segment_of_its_own(spark, folder):
    """Two runs of one id that close in the same batch are judged apart, and numbers keep four digits."""
    judge = judge_of(spark)
    rows = [("A", "x", True, 1, False, [1e-5, 2e-5, 3e-5, 4e-5], [i * 1_000_000 for i in range(4)]),
            ("A", "x", True, 1, False, [5.0, 6.0, 7.0, 8.0, 9e9], [i * 1_000_000 for i in range(100, 105)])]
    closed = spark.createDataFrame(rows, S.CLOSED)
    got = judge.features(closed).orderBy("len").collect()
    assert [(r["len"], round(r["mean"], 6)) for r in got] == [(4, 2.5e-5), (5, 1800000005.2)]
    judged = judge.judge(judge.features(closed))
    assert J.verdict_rows(judged).count() == 2
    from tidemark.operators.evidence import general_format
    shown = [r[0] for r in judged.select(general_format(F.col("mean"))).collect()]
    assert sorted(shown) == ["1.8e+09", "2.5e-05"]
