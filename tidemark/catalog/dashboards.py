"""Scans, sinks read back, projections, joins, dashboards, history."""

from __future__ import annotations

import tempfile

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog import Entry
from tidemark.catalog import inputs as I
from tidemark.catalog import judging as J
from tidemark.catalog import retrieval as H
from tidemark.catalog import telemetry as T
from tidemark.functions import severity as V
from tidemark.functions.hashing import set_digest, uniform
from tidemark.operators import evaluate as E
from tidemark.operators import features as X
from tidemark.operators import reports as D
from tidemark.operators import sampling as P
from tidemark.operators import segments as G
from tidemark.operators import ordering as O
from tidemark.schema import META, feature_columns
from tidemark.session import cut_lineage
from tidemark.sinks import tables as K
from tidemark.sources import points as N
from tidemark.sources import results as L
from tidemark.sources import tables as B


def rounded(df, *cols, places=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


def scratch(spark) -> str:
    """A new folder in the shared checkpoint place of a cluster, or a local one in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="run-", dir="/tmp")
    import uuid

    return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"


def marked(spark, sf):
    """Event points with a point label: the value is in the top tenth of the whole range."""
    return I.event_points(spark, sf).withColumn("anomaly", (F.col("value") > 200).cast("int"))


MARKED = f"{I.EVENT_POINTS}, m AS (SELECT *, CAST(value > 200 AS INTEGER) AS anomaly FROM pts)"


def alerts(spark, sf):
    """Alert rows from the judged item segments."""
    s = J.scored(spark, sf)
    return s.select(
        F.xxhash64("segment").alias("h"), "segment", "channel", F.round(F.col("hits") / 6.0, 4).alias("anomaly_score"), "hits",
        (F.col("hits") * 10.0 + F.col("judged")).alias("ts")).withColumn(
        "severity", V.by_score(F.col("anomaly_score"), F.col("channel"), ["RO"])).drop("h")


ALERTS = f"""{J.SCORED}, al AS (SELECT segment, channel, round(hits / 6.0, 4)::DOUBLE AS anomaly_score, hits, (hits * 10.0 + judged)::DOUBLE AS ts FROM scored),
alerts AS (SELECT *, CASE WHEN channel = 'RO' THEN 'nominal' WHEN anomaly_score > 0.4 THEN 'critical' WHEN anomaly_score > 0.15 THEN 'warning' WHEN anomaly_score > 0.05 THEN 'caution' ELSE 'nominal' END AS severity FROM al)"""


# ---- scans and sinks: written by Spark from the tables, read back by the readers

def point_scan(spark, sf):
    path = scratch(spark) + "/points"
    d = I.item_points(spark, sf)
    d.select("channel", "timestamp", "value", F.col("segment").alias("label"), "sampling", F.lit(0).alias("anomaly"),
             F.col("seq").alias("segment"), F.lit(1).alias("train")).write.parquet(path)
    back = N.read_points(spark, path).filter("channel = 'AF'")
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def csv_scan(spark, sf):
    """CSV with a byte order mark before the first column name."""
    path = scratch(spark) + "/csv"
    d = I.event_points(spark, sf).select(
        F.col("channel").alias("﻿channel"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "value",
        F.col("segment").alias("label"), "sampling", F.lit("True").alias("anomaly"), F.col("seq").alias("segment"), F.lit(1).alias("train"))
    d.write.option("header", True).csv(path)
    back = N.read_points(spark, path, "csv")
    return back.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.sum("anomaly").cast("long").alias("anomalies"),
        F.round(F.max(N.epoch_seconds(F.col("timestamp"))), 6).alias("last"))


def feature_scan(spark, sf):
    """Feature sink by train flag, feature cache, then a pruned read of the train partition."""
    folder = scratch(spark)
    d = J.segments(spark, sf).select("segment", "channel", "anomaly", "train", "mean", "len")
    K.write_features(d, folder + "/features")
    again = K.cached_table(spark, folder + "/cache", lambda: spark.read.parquet(folder + "/features"))
    return again.filter("train = 1").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mean"), 6).alias("total"))


def epoch_sort(spark, sf):
    d = I.event_points(spark, sf).select("seq", F.round(N.epoch_seconds(F.col("timestamp")), 6).alias("ts"))
    return d.orderBy("ts", "seq")


def jsonl_scan(spark, sf):
    """Record log written with failures as rows and read line by line."""
    path = scratch(spark) + "/log"
    d = J.scored(spark, sf).select("segment", "channel", (F.col("hits") < 3).alias("success"), F.col("score").alias("latency_s"))
    K.append_records(d, path)
    back = L.records(spark, path, "segment string, channel string, success boolean, latency_s double")
    return back.groupBy("channel", "success").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("latency_s"), 6).alias("total"))


def result_store(spark, sf):
    """Two runs of a result are kept; the newest is read."""
    folder = scratch(spark) + "/results"
    e = E.evaluate(J.rule_rows(spark, sf), group=["channel"])
    K.save_result(e.limit(1), folder, "rules", {"seed": "1"})
    K.save_result(e, folder, "rules", {"seed": "2"})
    newest, rows = L.latest_result(spark, folder, "rules")
    counted = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    return newest.crossJoin(counted).select("name", F.get_json_object("meta", "$.seed").alias("seed"), "n_rows")  # one row each


def recipe(spark, sf):
    """Recipe documents built from the gate choice of the item segments, and one malformed document."""
    from tidemark.operators import fusion as U

    gate = U.choose_gate(J.predicted(spark, sf).filter("split = 'val'"))
    doc = gate.agg(F.to_json(F.struct(F.struct(F.struct(
        F.map_from_entries(F.collect_list(F.struct("channel", F.struct("op")))).alias("gate_perchannel_choice"),
        F.map_from_entries(F.collect_list(F.struct("channel", F.lit(0.2)))).alias("best_contamination_per_channel"),
        F.lit(2).alias("best_k")).alias("selection")).alias("results"))).alias("value"))
    bad = doc.select(F.substring("value", 1, 20).alias("value"))
    return B.recipe_from_json(doc.unionByName(bad))


def split_scan(spark, sf):
    s = J.segments(spark, sf)
    return B.missing_segments(s.filter("channel <> 'RO'"), s.select("segment", "split"))


def frames(spark, sf):
    d = I.event_points(spark, sf).select("channel", "value")
    known = d.filter("channel <> 'error'").select("channel").distinct()
    return D.ingest_counts(d, known)


def alert_store(spark, sf):
    """Alert sink in two batches, one of them retried, then the scan with the payload."""
    path = scratch(spark) + "/alerts"
    a = alerts(spark, sf).withColumns({"channel_label": F.col("channel"), "first_ts": F.col("ts"), "last_ts": F.col("ts"),
                                       "summary": F.concat(F.lit("s-"), F.col("segment"))})
    K.append_alerts(a.filter("hits > 2"), path, 0)
    K.append_alerts(a.filter("hits <= 2"), path, 1)
    K.append_alerts(a.filter("hits <= 2"), path, 1)
    return B.alert_table(spark, path).select("segment", "severity", "official", "summary")


def verdict_store(spark, sf):
    """Verdict log: the second batch replaces the verdict of the segments it names."""
    path = scratch(spark) + "/verdicts"
    a = alerts(spark, sf).select("segment", "channel", "ts", "severity", F.lit(1).alias("n_points"))
    K.log_verdicts(a, path, 0)
    K.log_verdicts(a.filter("ts > 25").withColumn("severity", F.lit("updated")), path, 1)
    return K.current_verdicts(spark, path).select("segment", "channel", "severity")


def index_store(spark, sf):
    from tidemark.operators import retrieve as R

    folder = scratch(spark) + "/index"
    corpus = H.chunks(spark, sf)
    K.write_index(R.postings(corpus), R.index_statistics(corpus), corpus.drop("content"), folder, 8)
    d = R.bm25(corpus, H.keyword_queries(spark, sf), posted=spark.read.parquet(folder + "/postings"), stats=spark.read.parquet(folder + "/statistics"))
    return rounded(d, "score")


def extensions(spark, sf):
    from tidemark.sources.corpus import count_by_extension

    """A folder with one file per source of the documents and one per language of them, in two formats."""
    folder = scratch(spark)
    d = I.table(spark, sf, "documents").select("source", "lang", F.length("text").alias("n"))
    d.repartition("source").write.partitionBy("source").json(folder + "/kb/a")
    d.repartition("lang").write.partitionBy("lang").csv(folder + "/kb/b")
    return count_by_extension(spark, folder + "/kb", ("json", "csv", "pdf"))


def explanations_as_json(spark, sf):
    folder = scratch(spark)
    K.write_json(I.table(spark, sf, "conversations").select("conv_id", "turn", F.struct("role", F.md5("text").alias("digest")).alias("answer")), folder + "/explained")
    back = spark.read.schema("conv_id bigint, turn bigint, answer struct<role: string, digest: string>").json(folder + "/explained")
    return back.select("conv_id", "turn", "answer.role", "answer.digest")


# ---- projection, joins, sets

def projection(spark, sf):
    d = J.segments(spark, sf).select(*META, *J.COLS)
    cols = feature_columns(d)
    return rounded(d.filter("train = 1 AND channel = 'AF'").select(cols), *cols)


def semi_join(spark, sf):
    ids = alerts(spark, sf).filter("hits >= 1").select("segment")
    return P.semi_join_ids(J.segments(spark, sf), ids).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


def labels_of(spark, sf):
    return I.table(spark, sf, "nation").select(F.upper(F.substring("n_name", 1, 2)).alias("channel"), F.col("n_name").alias("label")).groupBy("channel").agg(F.min("label").alias("label"))


def lookup(spark, sf):
    d = alerts(spark, sf).select("segment", "channel").withColumn("channel", F.substring("channel", 1, 2))
    return D.label_lookup(d, labels_of(spark, sf))


def point_lookup(spark, sf):
    return D.point_lookup(alerts(spark, sf).select("segment", "channel", "anomaly_score"), "AF-7", "AF", "anomaly_score")


def set_operations(spark, sf):
    a = alerts(spark, sf).filter("hits >= 1").select("segment")
    b = J.segments(spark, sf).filter("anomaly = 1").select("segment")
    parts = [("intersect", a.intersect(b)), ("union", a.union(b).distinct()), ("except", a.exceptAll(b))]
    out = None
    for name, d in parts:
        d = d.agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(name))
        out = d if out is None else out.unionByName(d)
    overlap = P.split_overlap(J.segments(spark, sf)).select(F.col("overlapping").alias("n"), F.lit("overlap").alias("op"))
    return out.unionByName(overlap)


def outer_compare(spark, sf):
    a = J.scored(spark, sf).filter("channel <> 'AF'")
    b = J.scored(spark, sf, "test").filter("channel <> 'RO'")
    return E.agreement(a, b, ["segment"], ["hits", "judged"])


def piecewise_union(spark, sf):
    """Stratified sample, once by window and once as a union of channel pieces."""
    d = J.segments(spark, sf).select("segment", "channel")
    out = None
    for ch in ("AF", "AO", "NF", "NO", "RF", "RO"):
        piece = P.sample_per_group(d.filter(F.col("channel") == ch), "channel", "segment", 3)
        out = piece if out is None else out.unionByName(piece)
    return out.select("segment", "channel")


def series_grid(spark, sf):
    grid = F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k")
    d = J.scored(spark, sf).select("channel", "hits", grid)
    return d.groupBy("channel", "k").agg(F.count_if(F.col("hits") >= F.col("k")).cast("long").alias("flagged"))


def missing_values(spark, sf):
    d = J.segments(spark, sf).select("segment", F.when(F.col("skew") > 0, F.col("skew")).alias("skew"), F.when(F.col("mean") > 50, float("nan")).otherwise(F.col("mean")).alias("mean"))
    return d.select("segment", F.round(F.aggregate(X.feature_vector(["skew", "mean"]), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# ---- aggregates and windows

def metrics(spark, sf):
    d = marked(spark, sf)
    a = D.fault_count(alerts(spark, sf))
    return D.point_metrics(d).join(F.broadcast(a))


def ratio(spark, sf):
    return rounded(D.anomaly_ratio(marked(spark, sf)), "ratio")


def classes(spark, sf):
    return D.class_counts(J.segments(spark, sf), "channel", "split", ["fit", "val", "test"])


def totals(spark, sf):
    return D.alert_totals(alerts(spark, sf))


def sparkline(spark, sf):
    d = D.sparkline(marked(spark, sf), 500, ["error"])
    return d.select("channel", "n_points", "anomaly_rate", "status", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
                    F.array_join(F.transform("anomaly_positions", lambda i: i.cast("string")), ",").alias("positions"))


SPARK_SQL = f"""WITH {MARKED}, t AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY timestamp DESC, seq DESC) AS r FROM m),
w AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY timestamp, seq) - 1 AS i FROM t WHERE r <= 500)
SELECT channel, count(*) AS n_points, round(avg(anomaly), 4) AS anomaly_rate, CASE WHEN channel = 'error' THEN 'nominal' WHEN avg(anomaly) > 0.4 THEN 'critical' WHEN avg(anomaly) > 0.15 THEN 'warning' WHEN avg(anomaly) > 0 THEN 'caution' ELSE 'nominal' END AS status,
 round(sum(value), 4) AS total, coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (anomaly = 1), '') AS positions FROM w GROUP BY 1"""


def sliced_positions(spark, sf):
    """Positions inside channels that are cut into many slices."""
    d = O.positions(I.event_points(spark, sf), ["channel"], ["timestamp", "seq"], seconds=3600)
    return d.select("channel", "seq", "pos", "total")


def waveform(spark, sf):
    d = D.waveform(marked(spark, sf), "click", "click-20240110", 100)
    return d.select("pos", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "value", "anomaly", "mean", "std", "upper_3sigma", "lower_3sigma")


def waveform_anomaly(spark, sf):
    d = D.waveform(marked(spark, sf), "click", "none", 50)
    return d.select("pos", "value")


WAVE = f"""WITH {MARKED}, p AS (SELECT *, row_number() OVER (ORDER BY timestamp, seq) - 1 AS pos FROM m WHERE channel = 'click'),
c AS (SELECT pos AS centre FROM (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n FROM p WHERE @MARK@) WHERE i = n // 2),
b AS (SELECT avg(value) AS mean, stddev_samp(value) AS std FROM p)"""


def band(spark, sf):
    return rounded(D.baseline_band(I.item_points(spark, sf)), "mean", "std", "upper_3sigma", "lower_3sigma")


def queue(spark, sf):
    d = alerts(spark, sf).withColumn("explanation", F.concat(F.lit("explained "), F.repeat("segment", 30)))
    return D.alert_queue(d, ["RO"])


def stratified(spark, sf):
    return P.sample_per_group(J.segments(spark, sf).select("segment", "channel"), "channel", "segment", 5)


def sampled(spark, sf):
    return P.sample_rows(J.segments(spark, sf).select("segment", "channel"), "segment", 50)


def history(spark, sf):
    a = alerts(spark, sf).withColumn("id", F.col("segment"))
    page, total = D.alert_history(a, since=5.0, severity="warning", limit=20, offset=5)
    return page.select("id", "ts", "severity").join(F.broadcast(total))


def stages(spark, sf):
    d = E.evaluate(J.rule_rows(spark, sf), group=["channel"]).select(F.col("channel").alias("stage"), "f1")
    return rounded(D.improvement(d.filter("f1 > 0")), "f1", "improvement")


def ranking(spark, sf):
    d = E.evaluate(J.rule_rows(spark, sf), group=["channel"])
    return d.select("channel", F.round("f1", 4).alias("f1"), F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall")).orderBy(F.desc("f1"), "channel")


def duration_stats(spark, sf):
    return rounded(D.durations(J.scored(spark, sf), "score"), "median", "mean", "min", "max")


def quantile_stats(spark, sf):
    from tidemark.operators.fusion import distribution

    return rounded(distribution(J.scored(spark, sf), "score", F.lit(0.8)), "q00", "q10", "q25", "q50", "q75", "q90", "q100", "share_below")


def set_digest_sql(value):
    parts = [f"printf('%08x', CAST(sum(CAST('0x' || substr(md5({value}), {at}, 8) AS BIGINT)) % 4294967296 AS BIGINT))" for at in (1, 9, 17, 25)]
    return " || ".join(parts)


def digests(spark, sf):
    return J.segments(spark, sf).groupBy("split").agg(
        set_digest(F.col("segment")).alias("ids"), set_digest(F.concat_ws("#", F.col("segment"), F.col("anomaly").cast("string"))).alias("rows"))


def id_digest(spark, sf):
    return J.segments(spark, sf).groupBy("split").agg(set_digest(F.col("segment")).alias("ids"))


def query_counters(spark, sf):
    d = J.scored(spark, sf).select((F.col("hits") < 3).alias("success"), (F.col("score") * 100).alias("retrieval_ms"))
    return rounded(D.run_counters(d), "avg_retrieval_ms", "total_retrieval_ms", places=4)


def severity_filter(spark, sf):
    a = alerts(spark, sf)
    return D.filter_severity(a, "warning").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("anomaly_score") > 0.3).alias("strong"))


def feature_compare(spark, sf):
    a = J.segments(spark, sf)
    b = a.withColumn("mean", F.when(F.col("channel") == "AF", F.col("mean") + 0.5).otherwise(F.col("mean")))
    return rounded(X.compare_features(a, b, columns=J.COLS), "max_diff")


def enrichment(spark, sf):
    return rounded(X.shape_enrichment(J.segments(spark, sf)), "rate", "enrichment")


def audit(spark, sf):
    return rounded(D.scale_audit(J.segments(spark, sf), ["mean", "std", "skew", "kurtosis"]), "mean", "std", "p01", "p99", "scale_ratio")


def robust(spark, sf):
    d = J.segments(spark, sf)
    return rounded(D.scaled(d, d.filter("split = 'fit'"), ["mean", "std"]).select("segment", "mean", "std"), "mean", "std")


def standard(spark, sf):
    d = J.segments(spark, sf)
    return rounded(D.scaled(d, d.filter("split = 'fit'"), ["mean", "std"], "standard").select("segment", "mean", "std"), "mean", "std")


def seeds(spark, sf):
    """F1 over hash seeds of a half sample for two settings."""
    d = J.scored(spark, sf).select("segment", "anomaly", "hits", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seed"))
    d = d.filter(uniform(F.col("segment"), F.col("seed")) < 0.5)
    a = E.evaluate(d.withColumn("pred", (F.col("hits") >= 1).cast("int")), group=["seed"]).select("seed", F.col("f1").alias("loose"))
    b = E.evaluate(d.withColumn("pred", (F.col("hits") >= 2).cast("int")), group=["seed"]).select("seed", F.col("f1").alias("tight"))
    cols = [f"{x}_{y}" for x in ("loose", "tight") for y in ("mean", "std", "min", "max")]
    return rounded(E.seed_statistics(a.join(b, "seed"), "loose", "tight"), *cols)


def additivity(spark, sf):
    d = J.scored(spark, sf)
    f1 = lambda flag: E.evaluate(d.withColumn("pred", flag.cast("int"))).select("f1")
    h, s = F.col("hits"), F.col("score")
    parts = {"base": h >= 3, "b": h >= 2, "c": (h >= 3) | (s > 1.2), "d": (h >= 2) | (s > 1.2)}
    out = None
    for name, flag in parts.items():
        one = f1(flag).withColumnRenamed("f1", name)
        out = one if out is None else out.join(F.broadcast(one))
    return rounded(E.additivity(out), "joint", "sum_of_single", "interaction")


def deviation(spark, sf):
    e = E.evaluate(J.rule_rows(spark, sf), group=["channel"])
    return e.select("channel", E.deviation_level(F.col("recall"), F.lit(0.3)).alias("level"))


def choice_stability(spark, sf):
    """Features chosen in how many of five half samples, by distance of the AUC from one half."""
    from tidemark.operators import rules as R

    d = J.segments(spark, sf).select("segment", "anomaly", *J.COLS, F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seed"))
    d = d.filter(uniform(F.col("segment"), F.col("seed")) < 0.5)
    a = E.auc(R.long_form(d, ["seed", "anomaly"], J.COLS), ["seed", "feature"]).withColumn("strength", F.round(F.abs(F.col("auc") - 0.5), 9))
    picked = a.withColumn("r", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("strength"), "feature"))).filter("r <= 4")
    return picked.groupBy("feature").agg(F.count(F.lit(1)).alias("times"), (F.count(F.lit(1)) == 5).alias("always"))


# ---- the stream itself

def streamed_segments(spark, sf):
    """Declared segments closed by a stream over the events, which come as three loads in time order; what is open at the end is flushed."""
    from tidemark.streaming import judge as SJ
    from tidemark.streaming import segments as SS

    folder, setting = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    pts = I.event_points(spark, sf)
    first, last = pts.agg(F.min("timestamp"), F.max("timestamp")).first()
    step = (last - first) / 3
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, SS.STATE_STORE)
    try:
        for n in range(3):
            upper = F.col("timestamp") < F.lit(first + step * (n + 1)) if n < 2 else F.lit(True)
            pts.filter((F.col("timestamp") >= F.lit(first + step * n)) & upper).write.mode("append").parquet(f"{folder}/in")
            closed = SS.open_segments(spark.readStream.schema(pts.schema).parquet(f"{folder}/in"))
            counted = closed.select("channel", "segment", F.size("values").cast("long").alias("n_points"), F.element_at("clocks", -1).alias("last_clock"))
            query = counted.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").start(f"{folder}/closed")
            query.awaitTermination()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    sent = spark.read.schema("channel string, segment string, n_points bigint, last_clock bigint").parquet(f"{folder}/closed")
    batch = pts.groupBy("channel", "segment").agg(F.count(F.lit(1)).alias("n_points"), F.max(F.unix_micros("timestamp")).alias("last_clock"))
    left = SJ.unsent_segments(batch, sent, ["channel", "segment"])
    return sent.withColumn("flushed", F.lit(False)).unionByName(left.withColumn("flushed", F.lit(True)))


STREAMED_SQL = f"""WITH {I.EVENT_POINTS}, s AS (SELECT channel, segment, count(*) AS n_points, max(epoch_us(timestamp)) AS last_clock FROM pts GROUP BY 1, 2)
SELECT *, last_clock = max(last_clock) OVER (PARTITION BY channel) AS flushed FROM s"""


# ---- batch twins of the stream

def closed_segments(spark, sf):
    pts = G.segment_by_gap(I.user_points(spark, sf))
    d = G.segment_spans(pts, ["channel", "run"]).filter("n_points >= 3")
    return d.select("channel", "run", "n_points", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


def stream_verdicts(spark, sf):
    """Batch twin of the judged stream: gap segments of three points or more, per-test hits, severity."""
    pts = G.segment_by_gap(I.user_points(spark, sf)).withColumnRenamed("channel", "user").select(
        F.lit("all").alias("channel"), F.concat_ws("-", F.col("user"), F.col("run").cast("string")).alias("segment"), "timestamp", "seq", "value", "sampling")
    from tidemark.operators import fusion as U
    from tidemark.operators import rules as R

    f = cut_lineage(X.segment_features(pts).filter("len >= 3"))
    hit = R.rule_hits(f, R.thresholds(f, J.COLS), J.COLS, "test")
    rows = hit.withColumns({"margin": F.lit(None).cast("double"), "tau95": F.lit(0.0), "score_std": F.lit(1.0)})
    return U.verdicts(rows, []).select("segment", "hits", "is_anomaly", "severity", "anomaly_score")


STREAM_SQL = f"""WITH {I.USER_POINTS.replace('pts AS', 'p0 AS')}, g AS (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL OR
  (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 > greatest(3 * sampling, 5) THEN 1 ELSE 0 END AS opens FROM p0 WINDOW w AS (PARTITION BY channel ORDER BY timestamp, seq)),
pts AS (SELECT 'all' AS channel, channel || '-' || CAST(sum(opens) OVER (PARTITION BY channel ORDER BY timestamp, seq) AS BIGINT) AS segment, timestamp, seq, value, sampling FROM g),
{I.WHOLE_SQL}, f AS (SELECT * FROM whole WHERE len >= 3), {I.thresholds_sql('f', 'lim', J.COLS)}, {I.hits_sql('f', 'lim', 'h', J.COLS, 'test')}
SELECT segment, hits, hits >= 2 AS is_anomaly, CASE WHEN hits < 2 THEN 'nominal' WHEN hits >= 4 THEN 'critical' WHEN hits = 3 THEN 'warning' ELSE 'caution' END AS severity, round(least(hits / 6.0, 1.0), 4)::DOUBLE AS anomaly_score FROM h"""


def latest_state(spark, sf):
    d = I.event_points(spark, sf).select("channel", F.round(N.epoch_seconds(F.col("timestamp")), 6).alias("ts"), "value", F.lit("caution").alias("severity"), F.lit(False).alias("provisional"))
    every = d.select("channel").distinct().union(spark.range(1).select(F.lit("silent").alias("channel")))
    return D.channel_state(d, every)


def counters(spark, sf):
    d = I.event_points(spark, sf)
    v = alerts(spark, sf)
    return d.agg(F.count(F.lit(1)).alias("points")).join(F.broadcast(v.agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("severity") != "nominal").alias("alerts"))))


def provisional(spark, sf):
    """Preview severity of growing segments: hit counts stand for channels without a forest."""
    s = J.scored(spark, sf, "test")
    score = F.when(F.col("channel").isin("AF", "NF"), F.col("score"))
    return s.select("segment", V.by_preview(score, F.col("hits"), F.lit(1.0), F.lit(0.1)).alias("severity"))


U_SQL = I.u_sql("segment", 42)
ENTRIES = [
    Entry("a01_point_scan", point_scan, f"WITH {I.ITEM_POINTS} SELECT segment AS label, count(*) AS n, round(sum(value), 6) AS total FROM pts WHERE channel = 'AF' GROUP BY 1"),
    Entry("a03_csv_scan", csv_scan, "SELECT event_type AS channel, count(*) AS n, round(sum(value), 6) AS total, count(*) AS anomalies, round(max(epoch_us(ts)) / 1e6, 6) AS last FROM events GROUP BY 1"),
    Entry("a02_b01_feature_tables", feature_scan, f"WITH {I.ITEM_SEGMENTS} SELECT channel, count(*) AS n, round(sum(mean), 6) AS total FROM labelled WHERE train = 1 GROUP BY 1"),
    Entry("a04_epoch_sort", epoch_sort, "SELECT event_id AS seq, round(epoch_us(ts) / 1e6, 6) AS ts FROM events ORDER BY ts, seq"),
    Entry("a06_b07_record_log", jsonl_scan, f"WITH {J.SCORED} SELECT channel, hits < 3 AS success, count(*) AS n, round(sum(score), 6) AS total FROM scored GROUP BY 1, 2"),
    Entry("a05_b03_result_store", result_store, f"WITH {J.SCORED} SELECT 'rules' AS name, '2' AS seed, count(DISTINCT channel) AS n_rows FROM scored"),
    Entry("a07_split_scan", split_scan, f"WITH {I.ITEM_SEGMENTS} SELECT split, count(*) AS ids, count(*) FILTER (channel = 'RO') AS missing FROM labelled GROUP BY 1"),
    Entry("a08_recipe", recipe, f"WITH {J.SCORED}, {J.PREDICTED_SQL}, {J.GATE_SQL} SELECT channel, op, 0.2::DOUBLE AS contamination, 2 AS best_k FROM gate"),
    Entry("a10_extension_counts", extensions, "SELECT 'json' AS ext, count(DISTINCT source) AS n FROM documents UNION ALL SELECT 'csv', count(DISTINCT lang) FROM documents UNION ALL SELECT 'pdf', 0"),
    Entry("b06_explanations_json", explanations_as_json, "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, md5(text) AS digest FROM conversations"),
    Entry("a11_ingest_counts", frames, "SELECT count(*) FILTER (event_type <> 'error') AS accepted, count(*) FILTER (event_type = 'error') AS rejected FROM events"),
    Entry("a12_b04_alert_store", alert_store, f"WITH {ALERTS} SELECT segment, severity, 1 AS official, 's-' || segment AS summary FROM alerts"),
    Entry("b05_verdict_store", verdict_store, f"WITH {ALERTS} SELECT segment, channel, CASE WHEN ts > 25 THEN 'updated' ELSE severity END AS severity FROM alerts"),
    Entry("a13_b08_index_store", index_store, f"WITH {H.BM25_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM kw"),
    Entry("c14_compare_features", feature_compare, f"WITH {I.ITEM_SEGMENTS}, c(feature) AS (SELECT unnest({J.COLS})) SELECT feature, (SELECT count(*) FROM labelled) - (SELECT count(*) FROM labelled WHERE feature IN ('kurtosis', 'skew') AND var = 0) AS compared, CASE WHEN feature = 'mean' THEN 0.5 ELSE 0.0 END::DOUBLE AS max_diff, CASE WHEN feature = 'mean' THEN (SELECT count(*) FROM labelled WHERE channel = 'AF') ELSE 0 END AS mismatches FROM c"),
    Entry("c17_shape_enrichment", enrichment, f"""WITH {I.ITEM_SEGMENTS}, x AS (SELECT split, anomaly, CASE WHEN n_peaks >= 3 AND diff_peaks <= 2 THEN 'intermittent_spikes' WHEN diff_peaks >= 10 THEN 'high_freq_jitter'
     WHEN n_peaks <= 1 AND diff2_peaks <= 5 THEN 'low_activity' ELSE 'unusual_shapes' END AS shape FROM labelled), b AS (SELECT split, avg(anomaly) AS base FROM x GROUP BY 1)
     SELECT split, shape, count(*) AS n, round(avg(anomaly), 6) AS rate, round(avg(anomaly) / any_value(base), 6) AS enrichment FROM x JOIN b USING (split) GROUP BY 1, 2"""),
    Entry("c18_baseline_band", band, f"WITH {I.ITEM_POINTS} SELECT channel, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(avg(value) + 3 * stddev_samp(value), 6) AS upper_3sigma, round(avg(value) - 3 * stddev_samp(value), 6) AS lower_3sigma FROM pts GROUP BY 1"),
    Entry("c19_scale_audit", audit, f"""WITH {I.ITEM_SEGMENTS}, t AS (UNPIVOT (SELECT mean, std, skew, kurtosis FROM labelled) ON mean, std, skew, kurtosis INTO NAME feature VALUE value),
     s AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.99) AS p99 FROM t GROUP BY 1)
     SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std, round(p01, 6) AS p01, round(p99, 6) AS p99, round(std / (SELECT min(std) FROM s), 6) AS scale_ratio FROM s"""),
    Entry("c20_robust_scaling", robust, f"WITH {I.ITEM_SEGMENTS}, p AS (SELECT quantile_cont(mean, [0.25, 0.5, 0.75]) AS m, quantile_cont(std, [0.25, 0.5, 0.75]) AS s FROM labelled WHERE split = 'fit') SELECT segment, round((mean - m[2]) / (m[3] - m[1]), 6) AS mean, round((std - s[2]) / (s[3] - s[1]), 6) AS std FROM labelled, p"),
    Entry("c20_standard_scaling", standard, f"WITH {I.ITEM_SEGMENTS}, p AS (SELECT avg(mean) AS m, stddev_pop(mean) AS ms, avg(std) AS s, stddev_pop(std) AS ss FROM labelled WHERE split = 'fit') SELECT segment, round((mean - m) / ms, 6) AS mean, round((std - s) / ss, 6) AS std FROM labelled, p"),
    Entry("d01_d03_projection", projection, f"WITH {I.ITEM_SEGMENTS} SELECT {', '.join(c if c in ('len', *I.PEAK_FEATURES) else f'round({c}::DOUBLE, 6) AS {c}' for c in J.COLS)} FROM labelled WHERE train = 1 AND channel = 'AF'"),
    Entry("d04_semi_join", semi_join, f"WITH {J.SCORED} SELECT channel, count(*) AS n FROM scored WHERE hits >= 1 GROUP BY 1"),
    Entry("d07_label_lookup", lookup, f"WITH {J.SCORED}, l AS (SELECT upper(substring(n_name, 1, 2)) AS channel, min(n_name) AS label FROM nation GROUP BY 1) SELECT segment, s.channel, coalesce(label, s.channel) AS channel_label FROM scored s LEFT JOIN l ON l.channel = s.channel"),
    Entry("d08_point_lookup", point_lookup, f"WITH {ALERTS} SELECT segment, channel, anomaly_score FROM alerts WHERE segment = 'AF-7' AND channel = 'AF' ORDER BY anomaly_score LIMIT 1"),
    Entry("d09_set_operations", set_operations, f"""WITH {J.SCORED}, a AS (SELECT segment FROM scored WHERE hits >= 1), b AS (SELECT segment FROM scored WHERE anomaly = 1) SELECT 'intersect' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
     UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'overlap', 0"""),
    Entry("d10_outer_compare", outer_compare, f"""WITH {J.SCORED}, {I.hits_sql('labelled', 'lim', 'h2', J.COLS, 'test')}, j AS (SELECT a.segment AS a, b.segment AS b, a.hits AS x, b.hits AS y, a.judged AS c, b.judged AS d FROM (SELECT * FROM scored WHERE channel <> 'AF') a FULL JOIN (SELECT * FROM h2 WHERE channel <> 'RO') b ON a.segment = b.segment)
     SELECT count(*) AS rows, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, count(*) FILTER (x <> y) AS diff_hits, count(*) FILTER (c <> d) AS diff_judged FROM j"""),
    Entry("d11_piecewise_union", piecewise_union, f"WITH {I.ITEM_SEGMENTS} SELECT segment, channel FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY {U_SQL}, segment) AS r FROM labelled) WHERE r <= 3"),
    Entry("d12_series_grid", series_grid, f"WITH {J.SCORED} SELECT channel, k, count(*) FILTER (hits >= k) AS flagged FROM scored, (VALUES (1), (2), (3)) g(k) GROUP BY 1, 2"),
    Entry("d13_missing_values", missing_values, f"WITH {I.ITEM_SEGMENTS} SELECT segment, round(CASE WHEN skew > 0 THEN skew ELSE 0.0 END + CASE WHEN mean > 50 THEN 0.0 ELSE mean END, 6) AS total FROM labelled"),
    Entry("e01_metrics", metrics, f"WITH {ALERTS}, p AS (SELECT count(*) AS total_rows, count(*) FILTER (value > 200) AS anomaly_rows, round(avg(CAST(value > 200 AS INTEGER)), 4) AS point_anomaly_rate FROM events) SELECT p.*, count(*) AS total_anomalies, count(*) FILTER (anomaly_score > 0.05) AS fault_count FROM alerts, p GROUP BY ALL"),
    Entry("e02_anomaly_ratio", ratio, f"WITH {MARKED} SELECT channel, sum(anomaly)::BIGINT AS anomalies, count(*) AS n, round(avg(anomaly), 6) AS ratio FROM m GROUP BY 1"),
    Entry("e03_class_counts", classes, f"WITH {I.ITEM_SEGMENTS} SELECT channel, count(*) FILTER (split = 'fit') AS fit, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM labelled GROUP BY 1"),
    Entry("e08_alert_totals", totals, f"WITH {ALERTS} SELECT severity, channel, count(*) AS n FROM alerts GROUP BY GROUPING SETS ((), (severity), (channel))"),
    Entry("e09_sparkline", sparkline, SPARK_SQL),
    Entry("e09_positions", sliced_positions, f"WITH {I.EVENT_POINTS} SELECT channel, seq, row_number() OVER (PARTITION BY channel ORDER BY timestamp, seq) - 1 AS pos, count(*) OVER (PARTITION BY channel) AS total FROM pts"),
    Entry("e10_waveform", waveform, WAVE.replace("@MARK@", "segment = 'click-20240110'") + " SELECT pos, timestamp, value, anomaly, round(mean, 4) AS mean, round(std, 4) AS std, round(mean + 3 * std, 4) AS upper_3sigma, round(mean - 3 * std, 4) AS lower_3sigma FROM p, c, b WHERE pos >= centre - 100 AND pos < centre + 100"),
    Entry("e10_waveform_anomaly", waveform_anomaly, WAVE.replace("@MARK@", "anomaly = 1") + " SELECT pos, value FROM p, c WHERE pos >= centre - 50 AND pos < centre + 50"),
    Entry("e11_alert_queue", queue, f"WITH {ALERTS} SELECT segment, channel, anomaly_score, severity, substring('explained ' || repeat(segment, 30), 1, 120) || '...' AS summary FROM alerts WHERE anomaly_score > 0.05"),
    Entry("e12_stratified_sample", stratified, f"WITH {I.ITEM_SEGMENTS} SELECT segment, channel FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY {U_SQL}, segment) AS r FROM labelled) WHERE r <= 5"),
    Entry("e13_sample", sampled, f"WITH {I.ITEM_SEGMENTS} SELECT segment, channel FROM labelled ORDER BY {U_SQL}, segment LIMIT 50"),
    Entry("e14_history", history, f"WITH {ALERTS}, f AS (SELECT segment AS id, ts, severity, count(*) OVER () AS total FROM alerts WHERE ts >= 5 AND severity = 'warning') SELECT * FROM f ORDER BY ts DESC, id DESC LIMIT 20 OFFSET 5"),
    Entry("e15_improvement", stages, f"WITH {J.SCORED}, v AS (SELECT channel, anomaly AS y, CAST(hits >= 2 AS INTEGER) AS p FROM scored), m AS (SELECT channel AS stage, f1 FROM {J.metrics_sql('v', 'channel')} WHERE f1 > 0) SELECT stage, round(f1, 6) AS f1, round(CASE WHEN row_number() OVER w > 1 THEN (f1 - first_value(f1) OVER w) / first_value(f1) OVER w * 100 END, 6) AS improvement FROM m WINDOW w AS (ORDER BY stage)"),
    Entry("e16_f1_ranking", ranking, f"WITH {J.SCORED}, v AS (SELECT channel, anomaly AS y, CAST(hits >= 2 AS INTEGER) AS p FROM scored) SELECT channel, round(f1, 4) AS f1, round(precision, 4) AS precision, round(recall, 4) AS recall FROM {J.metrics_sql('v', 'channel')} ORDER BY f1 DESC, channel"),
    Entry("e17_durations", duration_stats, f"WITH {J.SCORED} SELECT round(median(score), 6) AS median, round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max FROM scored"),
    Entry("e18_quantiles", quantile_stats, f"WITH {J.SCORED} SELECT {', '.join(f'round(quantile_cont(score, {p}), 6) AS {n}' for n, p in (('q00', 0.0), ('q10', 0.1), ('q25', 0.25), ('q50', 0.5), ('q75', 0.75), ('q90', 0.9), ('q100', 1.0)))}, count(DISTINCT round(score, 6)) AS distinct_values, round(avg(CASE WHEN score < 0.8 - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS share_below FROM scored"),
    Entry("e19_digests", digests, f"WITH {I.ITEM_SEGMENTS} SELECT split, {set_digest_sql('segment')} AS ids, {set_digest_sql("segment || '#' || CAST(anomaly AS VARCHAR)")} AS rows FROM labelled GROUP BY 1"),
    Entry("e19_id_digest", id_digest, f"WITH {I.ITEM_SEGMENTS} SELECT split, {set_digest_sql('segment')} AS ids FROM labelled GROUP BY 1"),
    Entry("e20_run_counters", query_counters, f"WITH {J.SCORED} SELECT count(*) AS queries, count(*) FILTER (hits >= 3) AS failures, round(avg(score * 100), 4) AS avg_retrieval_ms, round(sum(score * 100), 4) AS total_retrieval_ms FROM scored"),
    Entry("f28_choice_stability", choice_stability, f"""WITH {I.ITEM_SEGMENTS}, d AS (SELECT l.*, s FROM labelled l, (SELECT unnest(range(1, 6)) AS s) WHERE {I.u_sql_tag('segment', 'CAST(s AS VARCHAR)')} < 0.5),
     tall AS (UNPIVOT (SELECT s, anomaly, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in J.COLS)} FROM d) ON {', '.join(J.COLS)} INTO NAME feature VALUE value),
     rk AS (SELECT *, rank() OVER (PARTITION BY s, feature ORDER BY value) + (count(*) OVER (PARTITION BY s, feature, value) - 1) / 2.0 AS r FROM tall),
     a AS (SELECT s, feature, round(abs((sum(r) FILTER (anomaly = 1) - sum(anomaly) * (sum(anomaly) + 1) / 2.0) / (sum(anomaly) * (count(*) - sum(anomaly))) - 0.5), 9) AS st FROM rk GROUP BY 1, 2),
     p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY st DESC, feature) AS k FROM a) SELECT feature, count(*) AS times, count(*) = 5 AS always FROM p WHERE k <= 4 GROUP BY 1"""),
    Entry("g09_seed_statistics", seeds, f"""WITH {J.SCORED}, d AS (SELECT s, anomaly AS y, hits FROM scored, (SELECT unnest(range(1, 6)) AS s) WHERE {I.u_sql_tag('segment', 'CAST(s AS VARCHAR)')} < 0.5),
     a AS (SELECT s, y, CAST(hits >= 1 AS INTEGER) AS p FROM d), b AS (SELECT s, y, CAST(hits >= 2 AS INTEGER) AS p FROM d), j AS (SELECT x.f1 AS l, z.f1 AS t FROM {J.metrics_sql('a', 's')} x JOIN {J.metrics_sql('b', 's')} z USING (s))
     SELECT {', '.join(f'round({f}({c}), 6) AS {n}_{k}' for c, n in (('l', 'loose'), ('t', 'tight')) for f, k in (('avg', 'mean'), ('stddev_samp', 'std'), ('min', 'min'), ('max', 'max')))}, min(l) <= max(t) AND min(t) <= max(l) AS overlap, bool_and(t > l) AS all_positive FROM j"""),
    Entry("g10_severity_filter", severity_filter, f"WITH {ALERTS} SELECT channel, count(*) AS n, count(*) FILTER (anomaly_score > 0.3) AS strong FROM alerts WHERE severity = 'warning' GROUP BY 1"),
    Entry("g11_additivity", additivity, f"""WITH {J.SCORED}, v AS (SELECT anomaly AS y, unnest(['base', 'b', 'c', 'd']) AS n, unnest([CAST(hits >= 3 AS INTEGER), CAST(hits >= 2 AS INTEGER), CAST(hits >= 3 OR score > 1.2 AS INTEGER), CAST(hits >= 2 OR score > 1.2 AS INTEGER)]) AS p FROM scored),
     m AS (SELECT max(f1) FILTER (n = 'base') AS base, max(f1) FILTER (n = 'b') AS b, max(f1) FILTER (n = 'c') AS c, max(f1) FILTER (n = 'd') AS d FROM {J.metrics_sql('v', 'n')})
     SELECT round(d - base, 6) AS joint, round((b - base) + (c - base), 6) AS sum_of_single, round((d - base) - ((b - base) + (c - base)), 6) AS interaction FROM m"""),
    Entry("g14_deviation", deviation, f"WITH {J.SCORED}, v AS (SELECT channel, anomaly AS y, CAST(hits >= 2 AS INTEGER) AS p FROM scored) SELECT channel, CASE WHEN abs(recall - 0.3) <= 0.02 THEN 'ok' WHEN abs(recall - 0.3) <= 0.05 THEN 'drift' ELSE 'off' END AS level FROM {J.metrics_sql('v', 'channel')}"),
    Entry("j01_streamed_segments", streamed_segments, STREAMED_SQL),
    Entry("j01_closed_segments", closed_segments, f"WITH {T.GAP_SQL} SELECT channel, run, count(*) AS n_points, max(timestamp) AS last_ts FROM segs GROUP BY 1, 2 HAVING count(*) >= 3"),
    Entry("j03_stream_verdicts", stream_verdicts, STREAM_SQL),
    Entry("j04_preview_severity", provisional, f"WITH {J.scored_sql('test')}, p AS (SELECT segment, hits, CASE WHEN channel IN ('AF', 'NF') THEN score END AS s FROM scored) SELECT segment, CASE WHEN s IS NOT NULL THEN CASE WHEN s > 1.0 + 3.0 * 0.1 THEN 'critical' WHEN s > 1.0 + 1.5 * 0.1 THEN 'warning' WHEN s > 1.0 THEN 'caution' ELSE 'nominal' END WHEN hits >= 4 THEN 'critical' WHEN hits >= 3 THEN 'warning' WHEN hits >= 2 THEN 'caution' ELSE 'nominal' END AS severity FROM p"),
    Entry("j05_latest_state", latest_state, "SELECT event_type AS channel, round(max(epoch_us(ts)) / 1e6, 6) AS ts, arg_max(value, ts) AS value, 'caution' AS severity, false AS provisional FROM events GROUP BY 1 UNION ALL SELECT 'silent', NULL, NULL, 'nominal', true"),
    Entry("j06_counters", counters, f"WITH {ALERTS} SELECT (SELECT count(*) FROM events) AS points, count(*) AS judged, count(*) FILTER (severity <> 'nominal') AS alerts FROM alerts"),
]
