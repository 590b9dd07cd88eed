"""Searches and robustness studies; candidates, repeats and seeds are grouping keys of one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions.hashing import uniform
from tidemark.operators import forest as T
from tidemark.operators import fusion as U
from tidemark.operators import rules as R
from tidemark.operators.evaluate import auc
from tidemark.operators.features import feature_vector
from tidemark.operators.ordering import positions
from tidemark.session import cut_lineage

MIN_GAIN = 1e-6


def forward_choice(fit: DataFrame, val: DataFrame, columns: list[str], steps: int = 8, trees: int = 100, psi: int = 128,
                   key: str = "segment") -> DataFrame:
    """Greedy forward choice by validation AUC of a forest; stops when nothing gains. Each step is one job over all candidates.

    With every step go the contamination that its forest would be given (first best validation F1 of its cuts) and that F1. Rows are
    dealt out and drawn for the trees once for all steps.
    """
    spark = fit.sparkSession
    chosen: list[str] = []
    path, best = [], 0.0
    vector = feature_vector(columns).alias("x")
    every = fit.select(key, F.lit(True).alias("fit"), F.lit(None).cast("int").alias("anomaly"), vector).unionByName(val.select(key, F.lit(False).alias("fit"), "anomaly", vector))
    rows = cut_lineage(every.repartition(2 * spark.sparkContext.defaultParallelism))
    drawn = cut_lineage(T.draws(rows.filter("fit"), F.col("x"), key, trees=trees, psi=psi, seed=42))
    unlabelled = rows.filter("anomaly IS NULL").count()
    for step in range(min(steps, len(columns))):
        left = [c for c in columns if c not in chosen]
        places = {c: [columns.index(x) for x in [*chosen, c]] for c in left}
        forest = T.grow_subsets(drawn, places, trees, seed=42)
        scored = cut_lineage(T.subset_scores(rows, forest, F.col("x"), places, ["anomaly"], trees))
        tall = scored.select("anomaly", F.posexplode("scores").alias("n", "score")).select(
            "anomaly", F.get(F.array(*map(F.lit, places)), F.col("n")).alias("candidate"), "score")
        seen, held = tall.filter("anomaly IS NULL"), tall.filter("anomaly IS NOT NULL")
        cuts = U.first_best(U.contamination_sweep(seen, held, group="candidate", largest=unlabelled), ["candidate"], ["c"]).select("candidate", "c", "f1")
        top = auc(held, ["candidate"], "score").join(cuts, "candidate", "left").orderBy(F.desc(F.round("auc", 9)), "candidate").first()
        if top is None or top["auc"] <= best + MIN_GAIN:
            break
        best = top["auc"]
        chosen.append(top["candidate"])
        path.append((step + 1, top["candidate"], float(best), top["c"], top["f1"]))
    return spark.createDataFrame(path, "step int, feature string, auc double, contamination double, f1 double")


def forest_sweep(fit: DataFrame, held: DataFrame, settings: dict[str, dict], columns: list[str], counts: list[int], key: str = "segment") -> DataFrame:
    """AUC per setting, forest size and split of forests over all channels.

    A setting (trees, psi, columns) is a key of one fit and one scoring; every forest size up to its trees is read off one descent.
    """
    entry = [F.struct(F.lit(name).alias("setting"), F.lit(s.get("trees", 100)).alias("trees"), F.lit(s.get("psi", 128)).alias("psi"),
                      feature_vector(s.get("columns", columns)).alias("x")) for name, s in settings.items()]

    def tried(rows: DataFrame, *keep: str) -> DataFrame:
        return rows.select(key, *keep, F.explode(F.array(*entry)).alias("s")).select(key, *keep, "s.*")

    forest = cut_lineage(T.fit(tried(fit), F.col("x"), key, "setting", F.col("trees"), F.col("psi")))
    scored = T.scores_by_size(tried(held, "split", "anomaly").drop("trees", "psi"), forest, F.col("x"), "setting", counts)
    return auc(cut_lineage(scored.select("setting", "trees", "split", "anomaly", F.round("score", 9).alias("score"))), ["setting", "trees", "split"], "score")


def largest_scale(audit: DataFrame, n: int = 5) -> list[str]:
    """Names of the features with the largest 99th percentile."""
    return [r["feature"] for r in audit.orderBy(F.desc(F.abs("p99")), "feature").limit(n).collect()]


def permutation_importance(rows: DataFrame, columns: list[str], predict, metric: Column | None = None, repeats: int = 5,
                           key: str = "segment", truth: str = "anomaly") -> DataFrame:
    """Mean and deviation of the metric's drop when one feature is permuted.

    ``predict`` maps rows with the feature columns (and keys ``repeat``, ``feature``) to rows with ``pred``. Row ranks by two hashes
    are matched, which permutes without collecting anything. ``metric`` is an expression over tn, fp, fn, tp (F1).
    """
    metric = M.f1() if metric is None else metric
    base = predict(rows.withColumns({"repeat": F.lit(0), "feature": F.lit("")})).agg(
        *M.counts(F.col(truth), F.col("pred"))).select(metric.alias("_base"))
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("f")
    long = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")).select("*", named).select("*", "f.*").drop("f")

    def ranked(df: DataFrame, tag: str) -> DataFrame:
        u = uniform(F.col(key), F.concat_ws(":", F.lit(tag), F.col("repeat").cast("string"), F.col("feature")))
        return positions(df.withColumn("_u", F.timestamp_micros((u * 1e9).cast("long"))), ["repeat", "feature"], ["_u", key], "_u", pos="_p", total="_n").drop("_u", "_n")

    donors = ranked(long, "to").select("repeat", "feature", "_p", F.col("value").alias("_new"))
    mixed = ranked(long, "from").join(donors, ["repeat", "feature", "_p"])
    for c in columns:
        mixed = mixed.withColumn(c, F.when(F.col("feature") == c, F.col("_new")).otherwise(F.col(c)))
    scored = predict(mixed.drop("_p", "_new", "value")).groupBy("repeat", "feature").agg(*M.counts(F.col(truth), F.col("pred")))
    drops = scored.select("feature", metric.alias("_m")).join(F.broadcast(base)).withColumn("drop", F.col("_base") - F.col("_m"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("mean_drop"), F.stddev_pop("drop").alias("std_drop"))


def coefficient_whitelist(rows: DataFrame, columns: list[str], n: int | None = None) -> DataFrame:
    """Absolute coefficients of a logistic regression on standardised features; output keeps the column order."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    flat = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(
        rows.select(F.col("anomaly").cast("double").alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]))
    ready = StandardScaler(inputCol="_x", outputCol="_v", withMean=True).fit(flat).transform(flat)
    model = LogisticRegression(featuresCol="_v", standardization=False, regParam=1.0 / max(rows.count(), 1), maxIter=200).fit(ready)
    table = rows.sparkSession.createDataFrame(
        [(i, c, float(w)) for i, (c, w) in enumerate(zip(columns, model.coefficients))], "place int, feature string, coefficient double")
    ranked = table.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.abs("coefficient")), "feature")))
    return (ranked if n is None else ranked.filter(F.col("rank") <= n)).orderBy("place")


def half_of(key: str, repeat: Column) -> Column:
    return (uniform(F.col(key), F.concat(F.lit("half"), repeat.cast("string"))) < 0.5).cast("int")


def nested_subsets(fit: DataFrame, val: DataFrame, columns: list[str], repeats: int = 20, steps: int = 5, trees: int = 100, psi: int = 128,
                   key: str = "segment") -> dict[int, list[str]]:
    """Per repeat the columns that a greedy choice by forest AUC takes on half 0 of the validation rows.

    One fit and one scoring a step serve all candidates of all repeats, as forests do not depend on the halves.
    """
    halves = cut_lineage(val.select(key, "anomaly", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")).withColumn("half", half_of(key, F.col("repeat"))).filter("half = 0"))
    chosen: dict[int, list[str]] = {r: [] for r in range(1, repeats + 1)}
    best, open_ = dict.fromkeys(chosen, -1.0), set(chosen)
    for _ in range(min(steps, len(columns))):
        tries = [(r, c, sorted([*chosen[r], c], key=columns.index)) for r in open_ for c in columns if c not in chosen[r]]
        if not tries:
            break
        places = {"+".join(x): [columns.index(c) for c in x] for *_, x in tries}
        forest = cut_lineage(T.fit_subsets(fit, feature_vector(columns), places, key, trees=trees, psi=psi))
        scored = cut_lineage(T.score_subsets(val, forest, feature_vector(columns), places, key))
        table = fit.sparkSession.createDataFrame([(r, c, "+".join(x)) for r, c, x in tries], "repeat int, candidate string, subset string")
        cells = halves.join(F.broadcast(table), "repeat").join(scored, [key, "subset"])
        areas = auc(cells, ["repeat", "candidate"], "score").withColumn("auc", F.round("auc", 9))
        top = areas.withColumn("_r", F.row_number().over(W.partitionBy("repeat").orderBy(F.desc("auc"), "candidate"))).filter("_r = 1")
        for r in top.collect():  # one row a repeat
            if chosen[r.repeat] and r.auc <= best[r.repeat] + MIN_GAIN:
                open_.discard(r.repeat)
            else:
                chosen[r.repeat].append(r.candidate)
                best[r.repeat] = r.auc
    return {r: sorted(x, key=columns.index) for r, x in chosen.items()}


def nested_validation(fit: DataFrame, val: DataFrame, columns: list[str], repeats: int = 20, steps: int = 5, trees: int = 100, psi: int = 128,
                      ks: tuple[int, ...] = (1, 2, 3, 4), key: str = "segment", group: str = "channel") -> DataFrame:
    """Per repeat: subset of columns, k, and per channel contamination and operator, all picked on one hash half; judged on the other against rules alone.

    The picks are windows over one table of counts by (repeat, half, channel, contamination, operator).
    """
    spark = fit.sparkSession
    chosen = nested_subsets(fit, val, columns, repeats, steps, trees, psi, key)
    picks = spark.createDataFrame([(r, "+".join(x)) for r, x in chosen.items()], "repeat int, subset string")
    members = spark.createDataFrame(sorted({("+".join(x), c) for x in chosen.values() for c in x}), "subset string, feature string")
    named = {"+".join(x): x for x in chosen.values()}
    entry = F.explode(F.array(*[F.struct(F.lit(n).alias("subset"), feature_vector(x).alias("x")) for n, x in named.items()])).alias("s")

    def tried(rows: DataFrame) -> DataFrame:
        return rows.select(key, group, "anomaly", entry).select(key, group, "anomaly", "s.*").withColumn("cell", F.concat_ws("|", "subset", group))

    fit_rows, val_rows = tried(fit), tried(val)
    places = {s: [columns.index(c) for c in x] for s, x in named.items()}
    forest = cut_lineage(T.fit_subsets(fit, feature_vector(columns), places, key, group, trees, psi))
    limits = T.contamination_thresholds(T.score(fit_rows, forest, F.col("x"), "cell").filter("score IS NOT NULL"), group="cell")
    fired = R.violations(val, R.thresholds(fit, columns), [key, group], columns).filter("sigma_hit OR iqr_hit")
    hits = fired.join(F.broadcast(members), "feature").groupBy("subset", key).agg(F.count(F.lit(1)).alias("hits"))
    scored = T.score(val_rows, forest, F.col("x"), "cell").drop("x").join(hits, ["subset", key], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    rows = cut_lineage(scored.join(F.broadcast(picks), "subset").withColumn("half", half_of(key, F.col("repeat"))))
    k = R.choose_k(rows.filter("half = 0"), ["repeat"], ks).select("repeat", "k")
    judged = rows.join(F.broadcast(k), "repeat").withColumn("rule_pred", (F.col("hits") >= F.col("k")).cast("int")).join(cut_lineage(limits), "cell", "left")
    judged = judged.withColumns({"c": F.coalesce("c", F.lit(0.0)), "if_pred": F.coalesce((F.col("score") > F.col("threshold")).cast("int"), F.lit(0))})
    table = cut_lineage(U.operator_counts(judged, group, ["repeat", "half", "c"]))
    best = U.first_best(table.filter("half = 0"), [group, "repeat"], ["c", "pos"]).select(group, "repeat", "c", "op")
    held = table.filter("half = 1")
    total = [F.sum(c).alias(c) for c in ("fp", "fn", "tp")]
    # A channel that half 0 has not goes by the rules.
    gate = held.join(best.withColumnRenamed("op", "_op").withColumnRenamed("c", "_c"), [group, "repeat"], "left")
    first_c = F.min("c").over(W.partitionBy(group, "repeat"))
    gate = gate.withColumn("_first", first_c).filter((F.col("op") == F.coalesce("_op", F.lit("rule"))) & (F.col("c") == F.coalesce("_c", "_first")))
    gate = gate.groupBy("repeat").agg(*total).select("repeat", M.f1().alias("gate_f1"))
    alone = judged.filter("half = 1").select("repeat", key, "anomaly", "rule_pred").distinct().groupBy("repeat").agg(*M.counts(F.col("anomaly"), F.col("rule_pred")))
    rule = alone.select("repeat", M.f1().alias("rule_f1"))
    delta = F.col("gate_f1") - F.col("rule_f1")
    return gate.join(rule, "repeat").join(picks, "repeat").join(k, "repeat").withColumn(
        "outcome", F.when(delta > 1e-12, "win").when(delta < -1e-12, "loss").otherwise("draw"))


def outcome_counts(nested: DataFrame) -> DataFrame:
    return nested.agg(F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "draw").alias("draws"),
                      F.count_if(F.col("outcome") == "loss").alias("losses"), F.avg("gate_f1").alias("gate_f1"), F.avg("rule_f1").alias("rule_f1"))
