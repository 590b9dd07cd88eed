"""Growing segments from a small state: features, timers, commands, late points, publication, the live store."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_streaming import feed, judge_of, points
from tidemark.functions import online as O
from tidemark.functions.series import series_features
from tidemark.operators.features import segment_features
from tidemark.operators.reports import channel_state
from tidemark.schema import FEATURES
from tidemark.streaming import growing as G
from tidemark.streaming import judge as J
from tidemark.streaming import publish as P

SCHEMA = "channel string, timestamp timestamp, seq long, value double, sampling int, segment string, command string"


def series(kind, n, rng):
    at = np.arange(n)
    return [rng.normal(size=n), np.cumsum(rng.normal(size=n)), np.sin(at * 0.3) * np.linspace(1, 0.2, n) + rng.normal(size=n) * 0.01, np.exp(at * 0.02) * np.sin(at),
            np.where(at % 7 < 3, 5.0, 0.0), np.ones(n)][kind]


@pytest.mark.parametrize("kind", range(6))
def test_online_features_equal_the_batch_kernel_after_every_chunk(kind, monkeypatch):
    monkeypatch.setattr(O, "KEEP", 30)
    rng = np.random.default_rng(kind)
    for _ in range(25):
        n = int(rng.integers(1, 400))
        x, t = series(kind, n, rng), np.cumsum(rng.integers(1, 9e6, size=n))
        g, handed, i = O.Growing(), {k: [] for k in O.PEAKS}, 0
        while i < n:
            step = int(rng.integers(1, 60))
            g.push(x[i:i + step], t[i:i + step])
            i += step
            g = O.Growing.load(g.dump())
            for name, part in g.spill():
                handed[name] += part
            got, want = g.features(), series_features([x[:i]], [t[:i]], "round")
            for k, name in enumerate(O.PEAKS):
                need = got["needs"][k] if got["needs"] else None
                assert got[name] + sum(p >= need for p in handed[name] if need is not None) == want[name][0]
            for name in ("diff_var", "diff2_var", "gaps_squared"):
                assert np.isclose(np.nan if got[name] is None else got[name], want[name][0], rtol=1e-9, atol=1e-12, equal_nan=True)
            part = x[:min(i, n)]
            d = part - part.mean()
            assert np.isclose(got["mean"], part.mean()) and np.isclose(got["var"], (d ** 2).mean(), atol=1e-12)
            if got["skew"] is not None and (d ** 2).mean() > 1e-9:
                assert np.isclose(got["skew"], (d ** 3).mean() / (d ** 2).mean() ** 1.5, atol=1e-8)
                assert np.isclose(got["kurtosis"], (d ** 4).mean() / (d ** 2).mean() ** 2 - 3, atol=1e-8)


def test_the_state_does_not_grow_with_the_segment():
    rng = np.random.default_rng(1)
    sizes = []
    g = O.Growing()
    for n in range(40):
        at = np.arange(n * 5000, (n + 1) * 5000)
        g.push(np.sin(at * 0.01) + rng.normal(size=5000), at * 1_000_000)
        g.spill()
        sizes.append(len(g.dump()))
    assert g.n == 200_000
    assert max(sizes) < 9 * 5 * (O.KEEP + 5000)  # rooms of five series, and a chunk beyond them
    assert max(sizes[20:]) < 1.3 * max(sizes[:20])


def run(spark, folder, loads, **options):
    """Rows of growing_segments over loads of plain tuples, each worked off before the next."""
    for load in loads:
        load.write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema(SCHEMA).parquet(folder + "/in")
        q = G.growing_segments(stream, **options).writeStream.format("parquet").option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start(folder + "/rows")
        q.awaitTermination(240)
        assert q.exception() is None
    return spark.read.schema(G.ROWS).parquet(folder + "/rows")


def rows(spark, given):
    """(channel, second, value, segment, command)"""
    return spark.createDataFrame([(c, float(t), n, v, 1, s, k) for n, (c, t, v, s, k) in enumerate(given)], "channel string, t double, seq long, value double, sampling int, segment string, command string").select(
        "channel", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("timestamp"), "seq", "value", "sampling", "segment", "command")


def test_mixed_segments_commands_and_missing_values(spark, folder):
    a = [("A", 0, 1.0, None, None), ("A", 5, 2.0, None, None), ("A", 11, 3.0, None, None), ("A", 12, 4.0, "7", None), ("A", 13, 5.0, None, None), ("A", 13.5, None, None, None), ("A", 13.6, float("nan"), "9", None)]
    b = [("A", 30, 6.0, "7", None), ("A", 31, 7.0, "8", None), ("A", 50, 8.0, None, None), ("B", 1, 1.0, "x", None), ("A", 51, None, None, G.FLUSH), ("A", 52, 9.0, "8", None), ("C", 3, None, None, G.FLUSH)]
    c = [("B", 2, 2.0, "x", None), ("B", 3, None, None, G.DROP), ("B", 4, 5.0, "x", None), ("A", 60, None, None, G.FLUSH), ("B", 9, None, None, G.FLUSH)]
    got = run(spark, folder, [rows(spark, x) for x in (a, b, c)]).select("channel", "kind", "segment", "run", "len", "mean").collect()
    told = sorted((r.channel, r.run, r.kind, r.segment, r.len, r["mean"]) for r in got)
    s = 1_000_000
    assert told == [("A", 0, "closed", "LIVE-A-0", 2, 1.5), ("A", 11 * s, "closed", f"LIVE-A-{11 * s}", 1, 3.0), ("A", 12 * s, "closed", "7", 3, 5.0), ("A", 31 * s, "closed", "8", 1, 7.0),
                    ("A", 50 * s, "closed", f"LIVE-A-{50 * s}", 1, 8.0), ("A", 52 * s, "closed", "8", 1, 9.0), ("B", s, "dropped", "x", 2, 1.5), ("B", 4 * s, "closed", "x", 1, 5.0)]


def test_late_points_are_listed_and_the_rest_is_put_in_order(spark, folder):
    first = [("A", t, float(t), "1", None) for t in (0, 3, 1, 10, 8)] + [("B", 100, 1.0, "1", None)]
    second = [("A", 4.5, 45.0, "1", None), ("A", 5, 5.0, "1", None), ("A", 20, 20.0, "2", None), ("A", 9, 9.0, "1", None), ("B", 95, 2.0, "1", None), ("B", 94, 3.0, "0", None)]
    got = run(spark, folder, [rows(spark, first), rows(spark, second), rows(spark, [(c, 200, None, None, G.FLUSH) for c in "AB"])], delay_seconds=5)
    late = sorted((r.channel, r.first_clock, r.last_value, r.segment) for r in got.filter("kind = 'late'").collect())
    assert late == [("A", 4_500_000, 45.0, "1"), ("B", 94_000_000, 3.0, "0")]
    closed = sorted((r.channel, r.segment, r.len, r["mean"], r.gaps_squared) for r in got.filter("kind = 'closed'").collect())
    # 0 1 3 5 8 9 10 in order, seconds apart 1 2 2 3 1 1
    assert closed == [("A", "1", 7, 36 / 7, 20.0), ("A", "2", 1, 20.0, 0.0), ("B", "1", 2, 1.5, 25.0)]


def test_an_idle_channel_is_closed_without_input(spark, folder):
    rows(spark, [("A", t, float(t), "1", None) for t in range(6)] + [("B", 1, 1.0, None, None)]).write.parquet(folder + "/in")
    stream = spark.readStream.schema(SCHEMA).parquet(folder + "/in")
    q = G.growing_segments(stream, delay_seconds=2, idle_seconds=2).writeStream.format("parquet").option("checkpointLocation", folder + "/cp").trigger(processingTime="500 milliseconds").start(folder + "/rows")
    try:
        for _ in range(240):
            time.sleep(0.5)
            assert q.exception() is None
            got = spark.read.schema(G.ROWS).parquet(folder + "/rows").collect() if q.lastProgress else []
            if len(got) == 2:
                break
    finally:
        q.stop()
    assert sorted((r.channel, r.kind, r.len) for r in got) == [("A", "closed", 6), ("B", "closed", 1)]


def test_judged_stream_publishes_changes_and_state(spark, folder):
    judge = judge_of(spark)
    stream = feed(spark, folder, 2)
    q = J.start(judge, G.growing_segments(stream, preview=True, delay_seconds=0), folder + "/out", folder + "/cp", interval=None)
    q.awaitTermination(240)
    assert q.exception() is None
    want = judge.judge(segment_features(points(spark), rounding="round").filter("len >= 3")).select("channel", "segment", "is_anomaly", "severity", F.round("raw_score", 4).alias("score"))
    got = spark.read.parquet(folder + "/out/judged").filter("NOT provisional")
    assert got.count() == 78 and got.select("channel", "segment", "is_anomaly", "severity", "score").exceptAll(want).count() == 0
    counters = spark.read.parquet(folder + "/out/counters").agg(F.sum("judged"), F.sum("previews"), F.sum("late")).first()
    assert counters[0] == 78 and counters[1] >= 2 and counters[2] == 0
    for _ in range(2):  # a second start finds nothing new
        P.start_publishing(spark, folder + "/out", folder + "/pub", interval=None).awaitTermination(240)
    sent = spark.read.parquet(folder + "/out/changes")
    alerts = sent.filter("kind = 'alert'").select("channel", "segment")
    assert alerts.exceptAll(want.filter("is_anomaly").select("channel", "segment")).count() == 0 and alerts.count() == got.filter("is_anomaly").count() > 0
    for channel in "AB":
        told = [(r.score, r.severity, r.provisional) for r in sent.filter((F.col("kind") == "score") & (F.col("channel") == channel)).orderBy("number").collect()]
        shown = [(r.score, r.severity, r.provisional) for r in spark.read.parquet(folder + "/out/judged").filter(F.col("channel") == channel).orderBy("ts", "provisional", "run").collect()]
        assert told == [s for n, s in enumerate(shown) if n == 0 or s != shown[n - 1]]
        numbers = sorted(r.number for r in sent.filter(F.col("channel") == channel).collect())
        assert numbers == list(range(1, len(numbers) + 1))
    channels = spark.createDataFrame([("A",), ("B",), ("silent",)], "channel string")
    state = {r.channel: r for r in channel_state(spark.read.parquet(folder + "/out/scores"), channels, channels.filter("channel <> 'silent'")).collect()}
    assert (state["silent"].severity, state["silent"].provisional, state["silent"].model, state["silent"].open_len, state["silent"].value) == ("nominal", True, "unavailable", 0, None)
    last = points(spark).filter("channel = 'A'").orderBy(F.desc("timestamp")).first()
    assert (state["A"].model, state["A"].provisional, state["A"].open_len, state["A"].value) == ("ready", True, 12, last.value)


def test_handed_out_swings_are_counted(spark, folder, monkeypatch):
    rng = np.random.default_rng(2)
    values = rng.normal(size=900)
    g, out = O.Growing(), []
    monkeypatch.setattr(O, "KEEP", 20)
    for i in range(0, 900, 90):
        g.push(values[i:i + 90], np.arange(i, i + 90) * 1_000_000)
        out += [("A", "swings", 0, s, p) for s, p in g.spill()]
    assert g.handed and out
    row = {"channel": "A", "kind": "closed", "segment": "1", "run": 0, "official": True, "sampling": 1, "first_clock": 0, "last_clock": 899_000_000, "last_value": 0.0, "handed": True, **g.features()}
    closed = spark.createDataFrame([tuple(row.get(c) for c in G.COLUMNS)], G.ROWS)
    swings = spark.createDataFrame(out, "channel string, kind string, run long, series string, swings array<double>")
    got = G.statistics(closed, swings).first()
    pts = spark.createDataFrame([("A", "1", i, float(v), 1) for i, v in enumerate(values)], "channel string, segment string, seq long, value double, sampling int").withColumn("timestamp", F.timestamp_seconds("seq"))
    want = segment_features(pts, rounding="round").first()
    for c in FEATURES:
        assert got[c] == pytest.approx(want[c], rel=1e-9)


def test_the_live_store_is_bounded_and_repeatable(spark, folder):
    d = points(spark).withColumn("part", F.ntile(3).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("timestamp", "seq")))
    for n in (0, 1, 1, 2, 2):  # batches tried again
        fresh = d.filter(F.col("part") == n + 1)
        P.retain(fresh.select("channel", "timestamp", "seq", "value"), fresh.filter("value > 5").select("channel", "segment", F.col("timestamp").alias("ts"), "value"), folder + "/live", n, keep=30)
    kept = P.live_store(spark, folder + "/live", "points")
    assert sorted((r.channel, r["count"]) for r in kept.groupBy("channel").count().collect()) == [("A", 30), ("B", 30)]
    newest = {r.seq for c in "AB" for r in points(spark).filter(F.col("channel") == c).orderBy(F.desc("timestamp"), F.desc("seq")).limit(30).collect()}
    assert {r.seq for r in kept.collect()} == newest
    alerts = P.live_store(spark, folder + "/live", "alerts")
    want = points(spark).filter("value > 5").groupBy("channel", "segment").agg(F.max("timestamp").alias("ts"))
    assert alerts.select("channel", "segment", "ts").exceptAll(want).count() == 0 and alerts.count() == want.count() > 0
