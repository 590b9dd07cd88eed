"""Combining rule hits and scores, with parameters chosen on validation rows.

Input rows: ``segment, channel, anomaly, split, hits, score`` (and 0/1 predictions ``rule_pred``, ``if_pred``).
Grids never multiply the rows by more than the number of weights: rows are reduced to (weight, bin, label)
counts and thresholds are tried on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions.hashing import uniform
from tidemark.operators.evaluate import evaluate
from tidemark.operators.forest import GRID, MIN_EVAL, MIN_FIT, contamination_thresholds, sufficient
from tidemark.operators.quantiles import quantiles
from tidemark.session import cut_lineage

# Parameter grids (thresholds start above zero) and the order in which ties are resolved.
WEIGHTS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
TAUS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]
CALIBRATED_TAUS = [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]
OPERATORS = ["rule", "if", "AND", "OR"]
VOTE_GRID = [0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50]


def _window(group: list[str], *order: Column):
    return W.partitionBy(*group).orderBy(*order) if group else W.orderBy(*order)


def first_best(scored: DataFrame, group: list[str], position: list[str], value: str = "f1") -> DataFrame:
    """First entry of the grid with the highest value; ties go to the earlier position."""
    w = _window(group, F.col(value).desc(), *[F.col(p) for p in position])
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def combine(rule: Column, forest: Column) -> dict[str, Column]:
    """The four combinations in tie order."""
    return {"rule": rule, "if": forest, "AND": F.least(rule, forest), "OR": F.greatest(rule, forest)}


def with_combinations(df: DataFrame, rule: str = "rule_pred", forest: str = "if_pred") -> DataFrame:
    both = combine(F.col(rule), F.col(forest))
    return df.withColumns({f"pred_{n}": c for n, c in both.items()})


# ---- contamination ------------------------------------------------------------------------

def contamination_sweep(fit_rows: DataFrame, eval_rows: DataFrame, grid: list[float] | None = None,
                        group: str = "channel", per_group: bool = True, largest: int | None = None) -> DataFrame:
    """F1 of ``score > threshold(c)`` for every c, per group or overall."""
    limits = contamination_thresholds(fit_rows, grid, group, largest=largest)
    packed = limits.groupBy(group).agg(F.collect_list(F.struct("c", "threshold")).alias("_t"))
    joined = eval_rows.join(packed, group).select(
        group, "anomaly", "score", F.explode("_t").alias("t")).select(group, "anomaly", "score", "t.*")
    keys = [group, "c"] if per_group else ["c"]
    return joined.groupBy(*keys).agg(
        *M.counts(F.col("anomaly"), (F.col("score") > F.col("threshold")).cast("int"))).select(*keys, *M.all_metrics())


def choose_contamination(fit_rows: DataFrame, val_rows: DataFrame, grid: list[float] | None = None,
                         group: str = "channel", largest: int | None = None) -> DataFrame:
    """Per group the first c with the best F1; NULL where there are too few rows."""
    best = first_best(contamination_sweep(fit_rows, val_rows, grid, group, largest=largest), [group], ["c"])
    known = sufficient(fit_rows, val_rows, group, MIN_FIT, MIN_EVAL)
    return known.join(best.select(group, "c", "f1"), group, "left").select(
        group, "n_fit", "n_eval", F.when(F.col("enough"), F.col("c")).alias("c"),
        F.when(F.col("enough"), F.col("f1")).alias("f1"))


def forest_prediction(rows: DataFrame, limits: DataFrame, chosen: DataFrame, group: str = "channel") -> DataFrame:
    """``if_pred`` from the chosen contamination; 0 without one."""
    cut = chosen.filter(F.col("c").isNotNull()).select(group, "c").join(limits, [group, "c"]).select(group, "threshold")
    joined = rows.join(cut, group, "left")
    return joined.withColumn(
        "if_pred", F.coalesce((F.col("score") > F.col("threshold")).cast("int"), F.lit(0))).withColumn(
        "margin", F.col("score") - F.col("threshold")).drop("threshold")


# ---- soft fusion --------------------------------------------------------------------------

def normalise(rows: DataFrame, group: str = "channel", fit_split: str = "fit") -> DataFrame:
    """``hits_norm`` by the global and ``score_norm`` by the group's minimum and maximum over fit rows, clipped to 0..1."""
    fit = rows.filter(F.col("split") == fit_split)
    per_group = fit.groupBy(group).agg(
        F.min("hits").alias("_h0"), F.max("hits").alias("_h1"), F.min("score").alias("_s0"), F.max("score").alias("_s1"))
    overall = per_group.agg(F.min("_h0").alias("_h0"), F.max("_h1").alias("_h1"))
    limits = per_group.drop("_h0", "_h1").join(F.broadcast(overall))
    top = F.when(F.col("_h1") <= F.col("_h0"), F.col("_h0") + 1.0).otherwise(F.col("_h1"))
    hits = (F.col("hits") - F.col("_h0")) / (top - F.col("_h0"))
    spread = F.col("_s1") - F.col("_s0")
    score = F.when(spread > 0, (F.col("score") - F.col("_s0")) / spread).otherwise(0.0)
    return rows.join(limits, group, "left").withColumn(
        "hits_norm", F.least(F.greatest(hits, F.lit(0.0)), F.lit(1.0))).withColumn(
        "score_norm", F.coalesce(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).drop(
        "_h0", "_h1", "_s0", "_s1")


def fused(weight: Column) -> Column:
    return weight * F.col("score_norm") + (F.lit(1.0) - weight) * F.col("hits_norm")


def _bins(value: Column, taus: list[float]) -> Column:
    """Number of thresholds the value reaches."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in taus]), lambda t: value >= t))


def _over_thresholds(cells: DataFrame, keys: list[str], taus: list[float]) -> DataFrame:
    """(keys, bin, anomaly, w) counts to F1 at every threshold."""
    tries = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("at"), F.lit(t).alias("tau")) for i, t in enumerate(taus)]))
    return cells.select("*", tries.alias("t")).groupBy(*keys, "t.tau").agg(
        *M.weighted_counts(F.col("anomaly"), (F.col("bin") >= F.col("t.at")).cast("int"), F.col("w"))).withColumn(
        "f1", M.f1())


def soft_grid(val: DataFrame, group: list[str] | None = None) -> DataFrame:
    """F1 of every (w, tau) on validation rows."""
    group = group or []
    tries = val.select(*group, "anomaly", "score_norm", "hits_norm", F.explode(F.array(*[F.lit(w) for w in WEIGHTS])).alias("w_"))
    cells = tries.select(*group, "anomaly", "w_", _bins(fused(F.col("w_")), TAUS).alias("bin")).groupBy(
        *group, "w_", "bin", "anomaly").agg(F.count(F.lit(1)).alias("w"))
    return _over_thresholds(cells, [*group, "w_"], TAUS).withColumnRenamed("w_", "weight")


def choose_soft(val: DataFrame, group: list[str] | None = None) -> DataFrame:
    group = group or []
    return first_best(soft_grid(val, group), group, ["weight", "tau"]).select(*group, "weight", "tau", "f1")


def apply_soft(rows: DataFrame, chosen: DataFrame, group: list[str] | None = None, out: str = "pred") -> DataFrame:
    params = chosen.select(*(group or []), "weight", "tau")
    joined = rows.join(params, group, "left") if group else rows.join(F.broadcast(params))
    return joined.withColumn(out, F.coalesce((fused(F.col("weight")) >= F.col("tau")).cast("int"), F.lit(0))).drop(
        "weight", "tau")


# ---- gate -----------------------------------------------------------------------------------

def operator_counts(rows: DataFrame, group: str = "channel", extra: list[str] | None = None) -> DataFrame:
    """Confusion counts per (group, operator) from one aggregate over the rows."""
    keys = [group, *(extra or [])]
    cells = rows.groupBy(*keys, "anomaly", "rule_pred", "if_pred").agg(F.count(F.lit(1)).alias("w"))
    both = combine(F.col("rule_pred"), F.col("if_pred"))
    tries = F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(n).alias("op"), c.alias("p")) for i, (n, c) in enumerate(both.items())]))
    return cells.select("*", tries.alias("o")).groupBy(*keys, "o.pos", "o.op").agg(
        *M.weighted_counts(F.col("anomaly"), F.col("o.p"), F.col("w"))).withColumn("f1", M.f1())


def choose_gate(val: DataFrame, group: str = "channel") -> DataFrame:
    """Per group the operator with the best F1; ties in the order rule, if, AND, OR."""
    return first_best(operator_counts(val, group), [group], ["pos"]).select(group, "op", "f1")


def apply_gate(rows: DataFrame, chosen: DataFrame, group: str = "channel", default: Column | None = None,
               out: str = "pred") -> DataFrame:
    """Prediction by each group's operator; groups without one use ``default`` (0)."""
    both = combine(F.col("rule_pred"), F.col("if_pred"))
    value = F.coalesce(default, F.lit(0)) if default is not None else F.lit(0)
    for n, c in both.items():
        value = F.when(F.col("op") == n, c).otherwise(value)
    return rows.join(chosen.select(group, "op"), group, "left").withColumn(out, value).drop("op")


def fallback_gate(chosen: DataFrame, census: DataFrame, group: str = "channel", min_rows: int = 30,
                  min_positives: int = 5, fallback: str = "rule") -> DataFrame:
    """Groups with few validation rows or positives use the fallback operator."""
    joined = chosen.join(census.select(group, F.col("n").alias("_n"), F.col("positives").alias("_p")), group, "left")
    thin = (F.coalesce("_n", F.lit(0)) < min_rows) | (F.coalesce("_p", F.lit(0)) < min_positives)
    return joined.withColumn("op", F.when(thin, fallback).otherwise(F.col("op"))).withColumn(
        "fell_back", thin).drop("_n", "_p")


def global_operator(val: DataFrame) -> DataFrame:
    """One operator for everything."""
    total = operator_counts(val).groupBy("pos", "op").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    return first_best(total.withColumn("f1", M.f1()), [], ["pos"]).select("op", "f1")


def tie_enumeration(val: DataFrame, test: DataFrame, cap: int = 20_000, seed: int = 0,
                    group: str = "channel") -> DataFrame:
    """Test F1 of every way to resolve validation ties.

    Counts add up over groups, so a combination needs one small sum. Combination i picks, in each group, the tied
    operator given by its digit in mixed radix; above the cap, combinations are drawn by hash instead.
    """
    scored = operator_counts(val, group).withColumn("_best", F.max("f1").over(W.partitionBy(group)))
    tied = scored.filter(F.col("_best") - F.col("f1") < 1e-12).select(group, "pos", "op")
    outcome = operator_counts(test, group).select(group, "op", "tp", "fp", "fn")
    options = tied.join(outcome, [group, "op"]).groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("pos", "tp", "fp", "fn"))).alias("opts"))
    table = options.agg(F.sort_array(F.collect_list(F.struct(F.col(group).alias("g"), "opts"))).alias("groups"))
    total = F.aggregate("groups", F.lit(1.0), lambda a, g: a * F.size(g["opts"]))
    exact = F.col("total") <= cap
    combos = table.withColumn("total", total).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("total"), F.lit(float(cap))).cast("long") - 1)))

    def step(acc: Column, g: Column) -> Column:
        n = F.size(g["opts"])
        drawn = F.floor(uniform(F.concat_ws(":", acc["i"].cast("string"), g["g"]), seed) * n)
        digit = F.when(acc["exact"], acc["rest"] % n).otherwise(drawn)
        pick = F.get(g["opts"], digit.cast("int"))
        return F.struct(
            acc["i"].alias("i"), acc["exact"].alias("exact"), F.floor(acc["rest"] / n).alias("rest"),
            (acc["tp"] + pick["tp"]).alias("tp"), (acc["fp"] + pick["fp"]).alias("fp"), (acc["fn"] + pick["fn"]).alias("fn"))

    zero = F.lit(0).cast("long")
    start = F.struct(F.col("i").alias("i"), exact.alias("exact"), F.col("i").alias("rest"), zero.alias("tp"),
                     zero.alias("fp"), zero.alias("fn"))
    return combos.withColumn("s", F.aggregate("groups", start, step)).select(
        "i", exact.alias("exact"), M.f1(F.col("s.tp"), F.col("s.fp"), F.col("s.fn")).alias("f1"))


def distribution(values: DataFrame, col: str, point: Column | None = None) -> DataFrame:
    """Min, tenths, quartiles, max, number of distinct rounded values, share below a point."""
    probs = {"q00": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q100": 1.0}
    aggs = [F.countDistinct(F.round(col, 6)).alias("distinct_values")]
    if point is not None:
        aggs.append(F.avg((F.col(col) < point - 1e-12).cast("double")).alias("share_below"))
    all_ = values.withColumn("_all", F.lit(1))
    return quantiles(all_, ["_all"], col, probs).join(all_.groupBy("_all").agg(*aggs), "_all").drop("_all")


# ---- fixed schemes --------------------------------------------------------------------------

def strong_weak(rows: DataFrame, strong: list[str], global_pred: str = "global_pred", out: str = "pred") -> DataFrame:
    """Strong channels: forest OR rule. Weak channels: the forest over all channels."""
    value = F.when(F.col("channel").isin(strong), F.greatest("rule_pred", "if_pred")).otherwise(F.col(global_pred))
    return rows.withColumn(out, value)


def verdicts(rows: DataFrame, strong: list[str], min_hits: int = 2) -> DataFrame:
    """Judgement of a closed segment: strong channels by forest or rules, weak ones by rules alone.

    ``hits`` counts tests. Severity and ``anomaly_score`` only colour the display.
    """
    is_strong = F.col("channel").isin(strong) & F.col("margin").isNotNull()
    rule = F.col("hits") >= min_hits
    forest = F.when(is_strong, F.col("margin") > 0)
    anomaly = F.when(is_strong, forest | rule).otherwise(rule)
    severity = (
        F.when(~anomaly, "nominal")
        .when(is_strong, F.when(forest & rule, "critical").otherwise("warning"))
        .when(F.col("hits") >= 4, "critical").when(F.col("hits") == 3, "warning").otherwise("caution"))
    over = F.greatest(F.col("margin") - F.col("tau95"), F.lit(0.0)) / (3.0 * F.col("score_std"))
    shown = F.when(is_strong, over).otherwise(F.col("hits") / 6.0)
    return rows.withColumns({
        "if_flag": forest, "rule_flag": rule, "is_anomaly": anomaly, "severity": severity,
        "raw_score": F.when(is_strong, F.col("margin")).otherwise(F.col("hits").cast("double")),
        "anomaly_score": F.round(F.least(shown, F.lit(1.0)), 4)})


def confidence(pred: Column, hits: Column, judged: Column) -> Column:
    """0.7 + 0.3 r when predicted, else 0.3 r, with r the share of violated features."""
    r = hits / F.greatest(judged, F.lit(1))
    return F.least(F.greatest(F.when(pred == 1, 0.7 + 0.3 * r).otherwise(0.3 * r), F.lit(0.0)), F.lit(1.0))


def segment_rollup(rows: DataFrame, threshold: float = 0.25, excluded: list[str] | None = None) -> DataFrame:
    """Window or segment predictions to one row per segment, with vote threshold and excluded channels.

    When every segment has one row, the score is the confidence; otherwise the share of positive rows.
    """
    seg = rows.groupBy("segment").agg(
        F.min("channel").alias("channel"), F.max("anomaly").alias("y_true"), F.avg("pred").alias("_mean"),
        F.count("pred").alias("n_rows"), F.max("pred").alias("_p"), F.max("hits").alias("_h"), F.max("judged").alias("_j"))
    widest = seg.agg(F.max("n_rows").alias("_widest"))
    conf = confidence(F.col("_p"), F.col("_h"), F.col("_j"))
    out = seg.join(F.broadcast(widest)).withColumn(
        "anomaly_score", F.when(F.col("_widest") == 1, conf).otherwise(F.col("_mean")))
    quiet = F.col("channel").isin(excluded) if excluded else F.lit(False)
    return out.select(
        "segment", "channel", "y_true", "n_rows",
        F.when(quiet, 0.0).otherwise(F.col("anomaly_score")).alias("anomaly_score"),
        (~quiet & (F.col("anomaly_score") >= threshold)).alias("is_anomaly"))


def vote_sweep(val: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """F1 of ``anomaly_score >= t`` for each vote threshold."""
    grid = grid or VOTE_GRID
    cells = val.groupBy(_bins(F.col("anomaly_score"), grid).alias("bin"), F.col("y_true").alias("anomaly")).agg(
        F.count(F.lit(1)).alias("w"))
    return _over_thresholds(cells, [], grid)


# ---- calibrated fusion ----------------------------------------------------------------------

def fold_of(rows: DataFrame, key: str = "segment", folds: int = 5, seed: int = 42, label: str = "anomaly") -> DataFrame:
    """Folds of equal shares inside every label: the label's hashed rows are cut at their quantiles."""
    drawn = rows.withColumn("_u", uniform(F.col(key), f"fold{seed}"))
    names = [f"_cut{i}" for i in range(1, folds)]
    cuts = quantiles(drawn, [label], "_u", {n: (i + 1) / folds for i, n in enumerate(names)})
    above = sum(((F.col("_u") > F.col(n)).cast("int") for n in names), F.lit(0))
    return drawn.join(cuts, label).withColumn("fold", above).drop("_u", *names).select(*rows.columns, "fold")


def calibrated(val: DataFrame, rows: DataFrame, key: str = "segment", folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Logistic regression on (hits_norm, score_norm); threshold from out-of-fold probabilities.

    Returns the out-of-fold table of validation rows and ``rows`` with ``probability``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    shape = VectorAssembler(inputCols=["hits_norm", "score_norm"], outputCol="_v")
    base = shape.transform(cut_lineage(fold_of(val, key, folds).withColumn("label", F.col("anomaly").cast("double"))))

    def model(train: DataFrame):
        n = max(train.count(), 1)
        return LogisticRegression(featuresCol="_v", labelCol="label", regParam=1.0 / n, elasticNetParam=0.0,
                                  standardization=False, maxIter=100).fit(train)

    def proba(fitted, df: DataFrame) -> DataFrame:
        return fitted.transform(df).withColumn("probability", vector_to_array("probability")[1]).drop(
            "rawPrediction", "prediction", "_v")

    parts = [proba(model(base.filter(F.col("fold") != k)), base.filter(F.col("fold") == k)) for k in range(folds)]
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return oof, proba(model(base), shape.transform(rows))


def choose_tau(oof: DataFrame) -> DataFrame:
    cells = oof.groupBy(_bins(F.col("probability"), CALIBRATED_TAUS).alias("bin"), "anomaly").agg(F.count(F.lit(1)).alias("w"))
    return first_best(_over_thresholds(cells, [], CALIBRATED_TAUS), [], ["tau"]).select("tau", "f1")


# ---- tables over strategies -----------------------------------------------------------------

def strategy_table(rows: DataFrame, preds: dict[str, str]) -> DataFrame:
    """Validation and test metrics of every strategy; ``best`` marks the best by validation F1, first wins."""
    named = F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(n).alias("strategy"), F.col(c).alias("p")) for i, (n, c) in enumerate(preds.items())]))
    flat = rows.select("split", "anomaly", named.alias("s")).select("split", "anomaly", "s.*")
    table = evaluate(flat, "p", "anomaly", ["pos", "strategy", "split"])
    best = first_best(table.filter("split = 'val'"), [], ["pos"]).select(F.col("strategy").alias("_best"))
    return table.join(F.broadcast(best)).withColumn("best", F.col("strategy") == F.col("_best")).drop("_best", "pos")


def rank_shift(left: DataFrame, right: DataFrame, key: str = "strategy", value: str = "f1") -> DataFrame:
    """Rank of each strategy under two configurations and how far it moved."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.col(value).alias(f"{value}_{name}"),
                         F.rank().over(W.orderBy(F.col(value).desc())).cast("long").alias(f"rank_{name}"))
    a, b = ranked(left, "a"), ranked(right, "b")
    return a.join(b, key).withColumn("shift", F.col("rank_a") - F.col("rank_b"))


def guard_report(rule: DataFrame, forests: DataFrame, group: str = "channel") -> DataFrame:
    """Advantage of the rules over the best forest of each group."""
    best = forests.groupBy(group).agg(F.max("f1").alias("best_forest_f1"))
    return rule.select(group, F.col("f1").alias("rule_f1")).join(best, group).withColumn(
        "advantage", F.col("rule_f1") - F.col("best_forest_f1"))


def whitelist(aucs: DataFrame, columns: list[str], n: int | None = None, minimum: float | None = None) -> DataFrame:
    """Features by distance of their AUC from one half; output keeps the original column order."""
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("feature"))
    rated = aucs.withColumn("strength", F.abs(F.col("auc") - 0.5)).withColumn("place", place)
    if minimum is not None:
        rated = rated.filter(F.col("strength") >= minimum)
    rated = rated.withColumn("rank", F.row_number().over(W.orderBy(F.col("strength").desc(), "feature")))
    if n is not None:
        rated = rated.filter(F.col("rank") <= n)
    return rated.select("feature", "auc", "strength", "place", "rank")
