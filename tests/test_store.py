import json

from pyspark.sql import functions as F

from tidemark.operators import ordering as O
from tidemark.operators import reports as D
from tidemark.schema import FEATURES
from tidemark.sinks import tables as K
from tidemark.sources import corpus as C
from tidemark.sources import points as N
from tidemark.sources import results as L
from tidemark.sources import tables as B


def test_positions_equal_a_plain_window(spark):
    from pyspark.sql import Window as W

    d = spark.range(500).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.pmod(F.col("id") * 37, F.lit(211))).alias("timestamp"), F.col("id").alias("seq"))
    w = W.partitionBy("k").orderBy("timestamp", "seq")
    want = d.select("k", "seq", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.count("*").over(W.partitionBy("k")).alias("total"))
    for seconds in (1, 10, 100_000):
        got = O.positions(d, ["k"], ["timestamp", "seq"], seconds=seconds).select("k", "seq", "pos", "total")
        assert got.exceptAll(want).count() == 0 and got.count() == 500
        tail = O.tail_rows(d, ["k"], ["timestamp", "seq"], 20, seconds=seconds)
        assert tail.count() == 60 and tail.join(want.filter("pos >= total - 20"), ["k", "seq"]).count() == 60


def test_bursts_are_cut_by_range(spark, monkeypatch):
    from pyspark.sql import Window as W

    d = spark.range(2000).select(F.lit("a").alias("k"), F.timestamp_seconds(F.when(F.col("id") < 1900, 5).otherwise(F.col("id"))).alias("timestamp"), F.col("id").alias("seq"))
    want = d.select("seq", (F.row_number().over(W.partitionBy("k").orderBy("timestamp", "seq")) - 1).cast("long").alias("pos"))
    cut = O.sliced(d, ["k"], ["timestamp", "seq"], target=50)
    assert cut.groupBy("_slice").count().agg(F.max("count")).first()[0] < 1500
    monkeypatch.setattr(O, "sliced", lambda df, keys, order, ts="timestamp", seconds=None: cut)
    assert O.positions(d, ["k"], ["timestamp", "seq"]).select("seq", "pos").exceptAll(want).count() == 0


def test_slice_width_follows_density(spark):
    d = spark.range(10_000).select(F.lit("a").alias("k"), F.timestamp_seconds("id").alias("timestamp"))
    assert O.slice_seconds(d, ["k"], target=100) == 99 or O.slice_seconds(d, ["k"], target=100) == 100
    assert O.slice_seconds(d, ["k"]) > 10_000


def test_csv_with_bom(spark, folder):
    with open(folder + "/p.csv", "w", encoding="utf-8-sig") as f:
        f.write("channel,timestamp,value,label,sampling,anomaly,segment,train\nA,2024-01-01T00:00:01Z,1.5,x,1,True,7,1\nA,bad,2.5,x,1,0,7,0\n")
    a, b = N.read_points(spark, folder + "/p.csv", "csv").orderBy("value").collect()
    assert (a.channel, a.value, a.anomaly, a.segment, a.timestamp.second) == ("A", 1.5, 1, 7, 1) and b.timestamp is None


def test_result_documents(spark, folder):
    import os

    for sub in ("", "/v3", "/v3/deep"):
        os.makedirs(folder + "/r" + sub, exist_ok=True)
        with open(f"{folder}/r{sub}/x.json", "w") as f:
            f.write('{"at": "%s"}' % sub)
    got = L.result_documents(spark, folder + "/r", "x.json").collect()
    assert [(r.depth, r.document) for r in got] == [(0, '{"at": ""}'), (1, '{"at": "/v3"}')]


def test_split_lists_and_completeness(spark, folder):
    import json

    import pytest

    with open(folder + "/s.json", "w") as f:
        json.dump({"fit_ids": [1, 2], "val_ids": [3], "test_ids": [4]}, f)
    split = B.split_from_lists(spark, folder + "/s.json")
    features = spark.createDataFrame([(1,), (2,), (3,), (4,)], "segment long")
    assert B.join_split(features, split).count() == 4
    with pytest.raises(ValueError):
        B.join_split(features.filter("segment < 4"), split)


def test_recipe(spark, folder):
    with open(folder + "/fusion.json", "w") as f:
        f.write('{"results": {"selection": {"gate_perchannel_choice": {"A": {"op": "AND", "val_f1": 0.5}}, '
                '"best_contamination_per_channel": {"A": 0.3}, "best_k": 2}}}')
    assert [tuple(r) for r in B.load_recipe(spark, folder + "/fusion.json").collect()] == [("A", "AND", 0.3, 2)]
    with open(folder + "/bad.json", "w") as f:
        f.write('{"results": {}}')
    assert B.load_recipe(spark, folder + "/bad.json").count() == 0


def test_markdown_and_extensions(spark, folder):
    for name in ("a.md", "b.md", "c.pdf"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("# t\ntext")
    meta = spark.createDataFrame([("a.md", "own", 0, "en")], "filename string, source_name string, priority int, language string")
    assert [(r.filename, r.text, r.priority) for r in C.markdown_files(spark, folder, meta).collect()] == [("a.md", "# t\ntext", 0)]
    assert {r.ext: r.n for r in C.count_by_extension(spark, folder).collect()} == {"pdf": 1, "md": 2, "html": 0}


def test_feature_cache_is_read_back(spark, folder):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert K.cached_table(spark, folder + "/c", compute).count() == 3
    assert K.cached_table(spark, folder + "/c", compute).count() == 3 and len(calls) == 1


def test_verdict_log_and_compaction(spark, folder):
    d = spark.createDataFrame([("1", "A", 5.0, "nominal"), ("2", "A", 6.0, "nominal")], "segment string, channel string, ts double, severity string")
    K.log_verdicts(d, folder + "/v", 0)
    K.log_verdicts(d.limit(1).withColumn("severity", F.lit("critical")), folder + "/v", 1)
    K.log_verdicts(d.limit(1).withColumn("severity", F.lit("warning")), folder + "/v", 1)
    K.compact_verdicts(spark, folder + "/v", folder + "/w")
    got = {r.segment: r.severity for r in spark.read.parquet(folder + "/w").collect()}
    assert got == {"1": "warning", "2": "nominal"}


def test_history_limits(spark):
    d = spark.range(1500).select("id", (F.col("id") % 10).cast("double").alias("ts"), F.lit("A").alias("channel"), F.lit("warning").alias("severity"))
    page, total = D.alert_history(d, limit=5000)
    assert page.count() == 1000 and total.first().total == 1500
    first = D.alert_history(d, since=3, until=5, limit=0, offset=1)[0].collect()
    assert [(r.ts, r.id) for r in first] == [(5.0, 1485)]


def test_silent_channels(spark):
    pts = spark.createDataFrame([("A", i, float(i), int(i == 4)) for i in range(6)], "channel string, seq long, value double, anomaly int").withColumn("timestamp", F.timestamp_seconds("seq"))
    chans = spark.createDataFrame([("A",), ("B",)], "channel string")
    got = {r.channel: r for r in D.sparkline(pts, 4, channels=chans).collect()}
    assert got["A"].anomaly_positions == [2] and got["A"].status == "warning" and got["B"].status == "offline"


def test_detection_plan(spark):
    from tidemark.plans.detect import detect

    base = spark.range(240).select(F.col("id").alias("segment"), F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "B").otherwise("Q").alias("channel"),
                                   (F.col("id") % 4 != 0).cast("int").alias("train"), F.lit(1).alias("sampling"))
    far = (F.floor(F.col("segment") / 12) % 9 == 4).cast("int")
    rows = base.withColumn("anomaly", far).select("*", *[(F.sin(F.col("segment") * (i + 1)) + far * (8 + i)).alias(c) for i, c in enumerate(FEATURES)])
    recipe = spark.createDataFrame([("A", "rule", 0.2, 2), ("B", "OR", 0.2, 2), ("Q", "rule", None, 2)], "channel string, op string, contamination double, best_k int")
    got = detect(rows, recipe, excluded=["Q"], trees=10, psi=32).collect()
    assert len(got) == 60 and all(0 <= r.anomaly_score <= 1 for r in got)
    assert all(not r.is_anomaly and r.anomaly_score == 0 for r in got if r.channel == "Q")
    assert any(r.is_anomaly for r in got if r.channel == "B")
    plain = detect(rows, None, trees=10, psi=32, strong=["A"]).collect()
    assert len(plain) == 60


def test_entry_points(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["channel", "segment", "hits", "judged", "rule_pred"] and out.count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_results_are_rows_beside_their_provenance(spark, folder):
    from tidemark.sinks.tables import save_result
    from tidemark.sources.results import latest_result, result_runs
    a, b = (spark.createDataFrame([(i, i * 0.5) for i in range(n)], "id long, value double") for n in (3, 1))
    save_result(a, folder, "one", {"seed": "1"})
    run = save_result(b, folder, "one", {"seed": "2", "note": "é"})
    save_result(a.limit(0), folder, "two", {})
    told, rows = latest_result(spark, folder, "one")
    assert told.first().run == run and json.loads(told.first().meta) == {"seed": "2", "note": "é"} and rows.collect() == b.collect()
    assert result_runs(spark, folder, "one").count() == 2
    assert latest_result(spark, folder, "two")[1].count() == 0 and latest_result(spark, folder, "three") is None
