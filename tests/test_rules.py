import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.operators import evaluate as E
from tidemark.operators import fusion as U
from tidemark.operators import rules as R
from tidemark.operators.quantiles import quantiles


def test_iqr_zero_stays_active(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (0.0,)], "v double")
    one = F.lit(1.0)
    assert [r[0] for r in d.select(R.iqr_rule(F.col("v"), one, one, F.lit(0.0))).collect()] == [False, True, True]


def test_strict_boundaries(spark):
    d = spark.createDataFrame([(10.0,), (-10.0,), (0.5,), (3.0,), (3.1,)], "v double")
    assert [r[0] for r in d.select(R.sigma_rule(F.col("v"), F.lit(0.0), F.lit(1.0))).collect()] == [True, True, False, False, True]
    d = spark.createDataFrame([(4.0,), (7.0,)], "v double")
    assert [r[0] for r in d.select(R.iqr_rule(F.col("v"), F.lit(1.0), F.lit(3.0), F.lit(2.0))).collect()] == [False, True]


def test_threshold_floor_and_minimum(spark):
    rows = [("A", 1.0, float(i) if i < 4 else None) for i in range(9)]
    t = {r.feature: r for r in R.thresholds(spark.createDataFrame(rows, "channel string, flat double, thin double"), ["flat", "thin"]).collect()}
    assert set(t) == {"flat"} and t["flat"].std == 1.0 and t["flat"].iqr == 0.0


def test_hit_modes_and_missing(spark):
    limits = spark.createDataFrame([("A", "mean", 9, 0.0, 1.0, -1.0, 1.0, 2.0), ("A", "std", 9, 0.0, 1.0, -1.0, 1.0, 2.0)],
                                   "channel string, feature string, n long, mean double, std double, q1 double, q3 double, iqr double")
    d = spark.createDataFrame([(1, "A", 10.0, 0.0), (2, "A", float("nan"), 10.0), (3, "A", None, None), (4, "Z", 10.0, 10.0)],
                              "segment long, channel string, mean double, std double")
    feature = {r.segment: (r.hits, r.judged) for r in R.rule_hits(d, limits, ["mean", "std"]).collect()}
    test = {r.segment: r.hits for r in R.rule_hits(d, limits, ["mean", "std"], "test").collect()}
    assert feature == {1: (1, 2), 2: (1, 1), 3: (0, 0), 4: (0, 0)}
    assert test == {1: 2, 2: 2, 3: 0, 4: 0}


def test_confusion_order_and_metrics(spark):
    d = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "anomaly int, pred int")
    r = E.evaluate(d).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 1, 1) and r.f1 == 0.5 and r.mcc == 0.0 and r.small_sample
    none = E.evaluate(d.filter("anomaly = 0").withColumn("pred", F.lit(0))).first()
    assert none.f1 == 0.0 and none.false_alarm_ratio is None


def test_quantiles_by_both_routes(spark):
    d = spark.range(1, 5001).select((F.col("id") % 7).alias("k"), (F.sin("id") * 100).alias("v"))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.975, "e": 1.0}
    small = {r.k: r for r in quantiles(d, ["k"], "v", probs).collect()}
    large = {r.k: r for r in quantiles(d, ["k"], "v", probs, small=10).collect()}
    for k in small:
        for p in probs:
            assert small[k][p] == pytest.approx(large[k][p], abs=1e-12)
    ties = spark.range(1000).select(F.lit(1).alias("k"), (F.col("id") % 3).cast("double").alias("v"))
    assert quantiles(ties, ["k"], "v", probs, small=10).collect() == quantiles(ties, ["k"], "v", probs).collect()


def test_auc_with_ties(spark):
    d = spark.createDataFrame([("f", 1.0, 0), ("f", 2.0, 0), ("f", 2.0, 1), ("f", 3.0, 1), ("g", 1.0, 1)], "feature string, value double, anomaly int")
    got = {r.feature: r.auc for r in E.auc(d, ["feature"]).collect()}
    assert got == {"f": 0.875, "g": 0.5}
    wide = spark.range(3000).select(F.lit("f").alias("feature"), F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double").alias("value"), (F.col("id") % 3 == 0).cast("int").alias("anomaly"))
    assert E.auc(wide, ["feature"]).first().auc == pytest.approx(E.auc(wide, ["feature"], large=10).first().auc, abs=1e-12)


def test_first_best_takes_the_earlier(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("a", 3, 0.4)], "g string, k int, f1 double")
    assert U.first_best(d, ["g"], ["k"]).first().k == 1


def test_confidence_edge(spark):
    d = spark.createDataFrame([(0, 14), (0, 15), (0, 16), (1, 0)], "pred int, hits int")
    got = [round(r[0], 4) for r in d.select(U.confidence(F.col("pred"), F.col("hits"), F.lit(18))).collect()]
    assert got == [0.2333, 0.25, 0.2667, 0.7]


def test_tau_grid_never_zero():
    assert min(U.TAUS) > 0 and len(U.TAUS) == 20 and len(U.WEIGHTS) == 11


def test_and_below_rule_below_or(spark):
    d = spark.range(200).select(F.lit("A").alias("channel"), (F.col("id") % 3 == 0).cast("int").alias("rule_pred"), (F.col("id") % 5 == 0).cast("int").alias("if_pred"))
    r = U.with_combinations(d).agg(*[F.sum(f"pred_{o}").alias(o) for o in U.OPERATORS]).first()
    assert r["AND"] <= r["rule"] <= r["OR"] and r["AND"] <= r["if"] <= r["OR"]


def test_tie_enumeration_sampled_lies_inside_exact(spark):
    d = spark.range(600).select(
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("channel"), (F.col("id") % 4 == 0).cast("int").alias("anomaly"),
        (F.col("id") % 5 == 0).cast("int").alias("rule_pred"), (F.col("id") % 7 == 0).cast("int").alias("if_pred"))
    val = d.withColumn("rule_pred", F.lit(0)).withColumn("if_pred", F.lit(0))  # everything ties
    exact = U.tie_enumeration(val, d)
    drawn = U.tie_enumeration(val, d, cap=30)
    assert exact.count() == 64 and exact.first().exact and drawn.count() == 30 and not drawn.first().exact
    lo, hi = exact.agg(F.min("f1"), F.max("f1")).first()
    a, b = drawn.agg(F.min("f1"), F.max("f1")).first()
    assert lo <= a <= b <= hi


def test_poisson_weight_mean(spark):
    from tidemark.functions.hashing import uniform

    m = spark.range(20000).agg(F.avg(E.poisson_weight(uniform(F.col("id"), 1)))).first()[0]
    assert abs(m - 1.0) < 0.03
    assert M.SMALL_SAMPLE == 30


def test_cell_bootstrap_agrees_with_row_bootstrap(spark):
    d = spark.range(4000).select("id", (F.col("id") % 5 == 0).cast("int").alias("anomaly"), (F.col("id") % 4 == 0).cast("int").alias("pred"))
    a = E.bootstrap_f1(d, "id", n_boot=150, method="rows").first()
    b = E.bootstrap_f1(d, "id", n_boot=150, method="cells").first()
    assert abs(a.f1_low - b.f1_low) < 0.02 and abs(a.f1_high - b.f1_high) < 0.02 and a.f1_low < a.f1_high
    assert E.bootstrap_f1(d, "id", n_boot=150, method="cells").first() == b
    p = E.paired_bootstrap(d.withColumn("other", F.col("anomaly")), "id", "pred", "other", n_boot=50, method="cells").first()
    assert p.delta_low > 0 and p.p_gain == 1.0


def test_quantile_bracket_that_misses_is_redone(spark, monkeypatch):
    from tidemark.operators import quantiles as Q

    rows = [("a", float(i * i % 9973)) for i in range(3000)] + [("b", 1.0)] * 50 + [("b", None), ("b", float("nan"))]
    d = spark.createDataFrame(rows, "k string, v double")
    probs = {"lo": 0.013, "mid": 0.5, "hi": 0.991}
    want = {r.k: (r.lo, r.mid, r.hi) for r in Q.quantiles(d, ["k"], "v", probs).collect()}
    for sketch in (10_000, 20):  # a sketch of twenty places promises less than the bracket assumes
        monkeypatch.setattr(Q, "SKETCH", sketch)
        got = {r.k: (r.lo, r.mid, r.hi) for r in Q.quantiles(d, ["k"], "v", probs, small=10).collect()}
        assert got == want


def test_folds_are_even_inside_labels(spark):
    from tidemark.operators.fusion import fold_of

    d = spark.range(1000).select(F.col("id").cast("string").alias("segment"), (F.col("id") % 10 == 0).cast("int").alias("anomaly"))
    n = {(r.anomaly, r.fold): r["count"] for r in fold_of(d).groupBy("anomaly", "fold").count().collect()}
    assert all(n[(1, k)] == 20 and n[(0, k)] == 180 for k in range(5))
