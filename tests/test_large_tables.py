"""Steps that grew faster than their tables: results as by the plain way, and dealt out as wanted."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.catalog import inputs as I
from tidemark.functions.hashing import uniform
from tidemark.operators import evaluate as E
from tidemark.operators import features as X


def test_bootstrap_draws_are_dealt_to_all_cores_and_are_the_same(spark):
    rows = [(f"s{i}" if i else None, i % 2, i % 3 % 2) for i in range(40)]
    table = spark.createDataFrame(rows, "segment string, anomaly int, pred int").coalesce(1)
    found = E.replicate_counts(table, "segment", ["pred"], n_boot=50)
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().toString()
    tag = F.concat_ws(":", F.lit("42"), F.col("replicate").cast("string"))
    draws = table.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("_w", E.poisson_weight(uniform(F.col("segment"), tag)))
    want = draws.groupBy("replicate").agg(*[
        F.sum(F.when((F.col("anomaly") == y) & (F.col("pred") == p), F.col("_w")).otherwise(0)).alias(f"pred_{n}")
        for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_plain_features_order_the_points_once(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(c, f"{c}-{s}", day + datetime.timedelta(hours=(7 * i) % 11, minutes=s), i, None if i == 4 else float((i * 37 + s) % 17), 5 + (i == 0))
            for c in ("a", "b", None) for s in range(3) for i in range(9 if s else 2)]
    points = spark.createDataFrame(rows, "channel string, segment string, timestamp timestamp, seq long, value double, sampling int")
    keys = ["channel", "segment"]
    got = I.plain_features(points)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan and "Join" not in plan
    want = X.derived(X.moments(points, keys, [F.max("value").alias("top")]).join(X.window_features(points, keys), keys))
    a, b = ({(r.channel, r.segment): r.asDict() for r in d.collect()} for d in (got, want))
    assert len(a) == 6 and a.keys() == b.keys()
    for k in a:
        assert a[k] == {n: v if v is None or not isinstance(v, float) else pytest.approx(v) for n, v in b[k].items()}
