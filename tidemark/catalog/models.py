"""Forests, searches, calibrated fusion and whole plans over the item segments: row counts and property tests only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Entry
from tidemark.catalog import inputs as I
from tidemark.catalog import judging as J
from tidemark.catalog import retrieval as H
from tidemark.operators import experiments as E
from tidemark.operators import features as X
from tidemark.operators import forest as T
from tidemark.operators import fusion as U
from tidemark.operators import reports as D
from tidemark.operators import retrieve as R
from tidemark.plans import detect as P
from tidemark.plans.evidence import explain
from tidemark.session import cut_lineage

COLS = J.COLS


TREES, PSI = 100, 128


def fit_forest(spark, sf, group="channel"):
    """Segments and their forest, fitted once an application."""
    rows = J.segments(spark, sf)
    forest = I.stored(spark, sf, f"forest_{group}", lambda: T.fit(rows.filter("split = 'fit'"), X.feature_vector(), group=group, trees=TREES, psi=PSI))
    return rows, forest


def forest_table(spark, sf):
    _, forest = fit_forest(spark, sf)
    return forest.select("grp", "tree", F.size("feature").alias("nodes"), "psi")


def scores(spark, sf):
    rows, forest = fit_forest(spark, sf)
    return T.score(rows, forest, X.feature_vector()).select("segment", "channel", F.round("score", 9).alias("score"))


def global_scores(spark, sf):
    rows, forest = fit_forest(spark, sf, None)
    return T.score(rows, forest, X.feature_vector(), None).select("segment", F.round("score", 9).alias("score"))


def salted_scores(spark, sf):
    """Scoring by the route for forests too large to broadcast."""
    rows, forest = fit_forest(spark, sf)
    return T.score(rows.select("segment", "channel", *X.FEATURES), forest, X.feature_vector(), max_broadcast=1, salts=4).select(
        "segment", F.round("score", 9).alias("score"))


def importance(spark, sf):
    _, forest = fit_forest(spark, sf)
    return J.rounded(T.split_importance(forest, X.FEATURES, 10), "share")


def c_sql(n):
    return f"(CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0::DOUBLE * (ln({n} - 1.0::DOUBLE) + {T.EULER}::DOUBLE) - 2.0::DOUBLE * ({n} - 1.0::DOUBLE) / {n} END)"


def vector_sql(columns):
    return "[" + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in columns) + "]"


def forest_sql(train, out, group, trees=TREES, psi=PSI, vector=None, width=len(X.FEATURES)):
    """Node tables out_n0, out_n1, ... of a forest, level by level, by the same draws of md5."""
    levels, vector = max(1, (psi - 1).bit_length()), vector or vector_sql(X.FEATURES)
    def u(what):
        return f"(CAST('0x' || substr(md5(grp || '#' || tree || '#42#' || node || '#{what}'), 1, 8) AS BIGINT) / 4294967296.0)"
    sql = f"""{out}_rows AS MATERIALIZED (SELECT {group} AS grp, CAST(segment AS VARCHAR) AS key, {vector} AS x, count(*) OVER (PARTITION BY {group}) AS n FROM {train}),
{out}_lots AS (SELECT *, {I.u_sql_tag('key', "'42:' || tree")} AS u FROM (SELECT *, unnest(range({trees})) AS tree FROM {out}_rows WHERE n >= {T.MIN_FIT})),
{out}_0 AS MATERIALIZED (SELECT grp, tree, x, 1::BIGINT AS node, least(n, {psi}) AS size FROM (SELECT *, row_number() OVER (PARTITION BY grp, tree ORDER BY u, key) AS r FROM {out}_lots) WHERE r <= {psi})"""
    for k in range(levels + 1):
        low, high = ("[" + ", ".join(f"{f}(x[{i}])" for i in range(1, width + 1)) + "]" for f in ("min", "max"))
        sql += f""",
{out}_m{k} AS (SELECT *, list_filter(range(1, {width + 1}), lambda i: hi[i] > lo[i]) AS usable FROM (SELECT grp, tree, node, any_value(size) AS size, count(*) AS n, {low} AS lo, {high} AS hi FROM {out}_{k} GROUP BY ALL)),
{out}_p{k} AS (SELECT *, CASE WHEN n > 1 AND {k} < greatest(1, ceil(log2(greatest(size, 2)))) AND len(usable) > 0 THEN usable[1 + CAST(floor({u('f')} * len(usable)) AS BIGINT)] END AS f FROM {out}_m{k}),
{out}_n{k} AS MATERIALIZED (SELECT grp, tree, node, size, f, lo[f] + {u('c')} * (hi[f] - lo[f]) AS cut, CASE WHEN f IS NULL THEN {k} + {c_sql('n')} END AS length FROM {out}_p{k})"""
        if k < levels:
            sql += f""",
{out}_{k + 1} AS MATERIALIZED (SELECT r.grp, r.tree, r.x, r.node * 2 + CASE WHEN r.x[f] <= cut THEN 0 ELSE 1 END AS node, r.size FROM {out}_{k} r JOIN {out}_n{k} USING (grp, tree, node) WHERE f IS NOT NULL)"""
    return sql


def paths_sql(rows, forest, out, group, psi=PSI, vector=None):
    """(segment, tree, length, size): where every row of ``rows`` ends in every tree of its group."""
    levels, vector = max(1, (psi - 1).bit_length()), vector or vector_sql(X.FEATURES)
    sql = f"{out}_d0 AS (SELECT segment, grp, tree, node, size, f, cut, length, x FROM (SELECT segment, {group} AS grp, {vector} AS x FROM {rows}) JOIN {forest}_n0 USING (grp))"
    for k in range(levels):
        sql += f""",
{out}_d{k + 1} AS (SELECT d.segment, d.grp, d.tree, m.node, d.size, m.f, m.cut, m.length, d.x FROM {out}_d{k} d JOIN {forest}_n{k + 1} m ON m.grp = d.grp AND m.tree = d.tree
  AND m.node = d.node * 2 + CASE WHEN d.x[d.f] <= d.cut THEN 0 ELSE 1 END WHERE d.f IS NOT NULL)"""
    return sql + f", {out} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT segment, grp, tree, size, length FROM {out}_d{k} WHERE f IS NULL" for k in range(levels + 1)) + ")"


def score_sql(paths):
    return f"(SELECT segment, pow(2.0, -(sum(length) / count(*)) / {c_sql('any_value(size)')}) AS score FROM {paths} GROUP BY segment)"


FIT_SQL = f"{I.ITEM_SEGMENTS}, fitrows AS (SELECT * FROM labelled WHERE split = 'fit')"
FOREST_SQL = f"WITH {FIT_SQL}, {forest_sql('fitrows', 'fo', 'channel')}"
NODES_SQL = "(" + " UNION ALL ".join(f"SELECT grp, tree, size, f FROM fo_n{k}" for k in range((PSI - 1).bit_length() + 1)) + ")"
SCORES_SQL = f"{FOREST_SQL}, {paths_sql('labelled', 'fo', 'pa', 'channel')}, sc AS {score_sql('pa')}"
GLOBAL_SQL = f"WITH {FIT_SQL}, {forest_sql('fitrows', 'fo', repr('*'))}, {paths_sql('labelled', 'fo', 'pa', repr('*'))} SELECT segment, round(score, 9) AS score FROM {score_sql('pa')}"


def permutation(spark, sf):
    """All features, ten repeats, by the F1 of the forest's cut at a contamination of 0.2."""
    rows, forest = fit_forest(spark, sf)
    vector = X.feature_vector()
    cut = cut_lineage(T.contamination_thresholds(T.score(rows.filter("split = 'fit'"), forest, vector), [0.2]).select("channel", "threshold"))

    def predict(d):
        return T.score(d, forest, vector).join(cut, "channel").withColumn("pred", (F.col("score") > F.col("threshold")).cast("int"))

    test = rows.filter("split <> 'fit'").select("segment", "channel", "anomaly", *X.FEATURES)
    return J.rounded(E.permutation_importance(test, X.FEATURES, predict, repeats=10), "mean_drop", "std_drop")


def forward(spark, sf):
    rows = J.segments(spark, sf)
    return E.forward_choice(rows.filter("split = 'fit'"), rows.filter("split = 'val'"), X.FEATURES, 8, TREES)


COUNTS = [100, 300, 1000]


def sweep(spark, sf):
    """Forest size with all features and without the five of the largest scale; subsample size with all."""
    rows = J.segments(spark, sf)
    fit = rows.filter("split = 'fit'")
    wide = E.largest_scale(D.scale_audit(fit, X.FEATURES))
    settings = {"all": {"trees": max(COUNTS)}, "without_largest": {"trees": max(COUNTS), "columns": [c for c in X.FEATURES if c not in wide]},
                **{f"psi{n}": {"psi": n} for n in (64, 256, 512)}}
    return J.rounded(E.forest_sweep(fit, rows.filter("split <> 'fit'"), settings, X.FEATURES, COUNTS), "auc")


SCALE_SQL = f"""tallfit AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in X.FEATURES)} FROM fitrows) ON {', '.join(X.FEATURES)} INTO NAME feature VALUE value),
p99 AS (SELECT feature, row_number() OVER (ORDER BY abs(quantile_cont(value, 0.99)) DESC, feature) AS r FROM tallfit GROUP BY feature),
kept AS (SELECT list(list_position({list(X.FEATURES)}, feature) ORDER BY list_position({list(X.FEATURES)}, feature)) AS places FROM p99 WHERE r > 5)"""
FEW_SQL = f"list_transform((SELECT places FROM kept), lambda i: {vector_sql(X.FEATURES)}[i])"
SWEEP_SETTINGS = {"all": {"trees": max(COUNTS)}, "without_largest": {"trees": max(COUNTS), "vector": FEW_SQL, "width": len(X.FEATURES) - 5}, **{f"psi{n}": {"psi": n} for n in (64, 256, 512)}}


def _sweep_sql():
    parts, sizes = [], []
    for n, (name, s) in enumerate(SWEEP_SETTINGS.items()):
        rest = {k: v for k, v in s.items() if k in ("psi", "vector")}
        parts += [forest_sql("fitrows", f"s{n}", repr(name), **s), paths_sql("heldrows", f"s{n}", f"w{n}", repr(name), **rest)]
        for c in COUNTS:
            if c <= s.get("trees", TREES):
                sizes.append(f"SELECT segment, '{name}' AS setting, {c} AS trees, round(pow(2.0, -(sum(length) / {c}) / {c_sql('any_value(size)')}), 9) AS v FROM w{n} WHERE tree < {c} GROUP BY segment")
    return f"""WITH {FIT_SQL}, heldrows AS (SELECT * FROM labelled WHERE split <> 'fit'), {SCALE_SQL}, {', '.join(parts)}, s AS (SELECT * FROM ({' UNION ALL '.join(sizes)}) JOIN (SELECT segment, split, anomaly FROM heldrows) USING (segment)),
k AS (SELECT *, rank() OVER (PARTITION BY setting, trees, split ORDER BY v) + (count(*) OVER (PARTITION BY setting, trees, split, v) - 1) / 2.0 AS r FROM s)
SELECT setting, trees, split, count(*) AS n, sum(anomaly)::BIGINT AS positives, round((sum(r) FILTER (anomaly = 1) - sum(anomaly) * (sum(anomaly) + 1) / 2.0) / (sum(anomaly) * (count(*) - sum(anomaly))), 6) AS auc FROM k GROUP BY 1, 2, 3"""


def coefficients(spark, sf):
    return E.coefficient_whitelist(J.segments(spark, sf).filter("split = 'val'"), COLS, 6)


def calibrated(spark, sf):
    rows = U.normalise(J.predicted(spark, sf))
    oof, scored = U.calibrated(rows.filter("split = 'val'"), rows.filter("split = 'test'"))
    tau = U.choose_tau(oof)
    return scored.join(F.broadcast(tau.select("tau"))).select("segment", (F.col("probability") >= F.col("tau")).cast("int").alias("pred"))


def all_eight(spark, sf):
    """The strategy table with the calibrated fusion as its eighth strategy."""
    rows = J.all_strategies(spark, sf).filter("split <> 'fit'")
    oof, scored = U.calibrated(rows.filter("split = 'val'"), rows)
    tau = U.choose_tau(oof).select(F.col("tau").alias("_tau"))  # one row
    rows = scored.crossJoin(F.broadcast(tau)).withColumn("calibrated", (F.col("probability") >= F.col("_tau")).cast("int"))
    return J.rounded(U.strategy_table(rows, J.STRATEGY_NAMES | {"soft_calibrated": "calibrated"}), *J.RATES)


def nested(spark, sf):
    """Subset, k, contamination and operator picked on one half of the validation rows, judged on the other."""
    rows = J.segments(spark, sf)
    def build():
        return E.nested_validation(rows.filter("split = 'fit'"), rows.filter("split = 'val'"), X.FEATURES, trees=TREES, psi=PSI)
    return J.rounded(I.stored(spark, sf, "nested", build), "gate_f1", "rule_f1")


def nested_outcomes(spark, sf):
    return E.outcome_counts(nested(spark, sf))


def detection(spark, sf):
    """Whole batch plan with a recipe: every channel by OR, two channels left to the forest over all."""
    rows = J.segments(spark, sf)
    recipe = rows.select("channel").distinct().filter("channel NOT IN ('RO', 'NO')").select(
        "channel", F.lit("OR").alias("op"), F.lit(0.2).alias("contamination"), F.lit(2).alias("best_k"))
    return P.detect(rows.select("channel", "segment", "anomaly", "train", "sampling", *X.FEATURES), recipe, excluded=["RF"], trees=TREES)


def evidence(spark, sf):
    """Flagged segments to explained segments; retrieval is the keyword side over the documents."""
    found = detection(spark, sf).filter("is_anomaly")
    corpus = H.chunks(spark, sf)
    names = corpus.select("chunk_id", "content", F.col("source_name").alias("filename"), F.col("priority").alias("page"))

    def retrieve(queries):
        return R.keyword_top(H.term_index(spark, sf), queries, 5).join(names, "chunk_id")

    labels = I.table(spark, sf, "nation").select(F.substring("n_name", 1, 2).alias("channel"), F.col("n_name").alias("label")).groupBy("channel").agg(F.min("label").alias("label"))
    return explain(found, labels, retrieve).select("segment", "query", "pieces", "prompt", "answer", "success")


def descriptions(spark, sf):
    from tidemark.operators.evidence import describe_anomaly

    rows = J.segments(spark, sf)
    return rows.select("segment", describe_anomaly(F.col("channel"), X.shape_class(), F.lit(0.75), X.feature_summary()).alias("text"))


ENTRIES = [
    Entry("f08_forest", forest_table, f"{FOREST_SQL} SELECT grp, tree::INTEGER AS tree, count(*)::INTEGER AS nodes, any_value(size)::INTEGER AS psi FROM {NODES_SQL} GROUP BY 1, 2"),
    Entry("f10_forest_scores", scores, f"{SCORES_SQL} SELECT segment, channel, round(score, 9) AS score FROM labelled LEFT JOIN sc USING (segment)"),
    Entry("f10_forest_scores_salted", salted_scores, f"{SCORES_SQL} SELECT segment, round(score, 9) AS score FROM labelled LEFT JOIN sc USING (segment)"),
    Entry("f09_global_forest", global_scores, GLOBAL_SQL),
    Entry("f36_split_importance", importance, f"{FOREST_SQL} SELECT {list(X.FEATURES)}[f] AS feature, count(*) AS splits, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {NODES_SQL} WHERE f IS NOT NULL GROUP BY f ORDER BY splits DESC, feature LIMIT 10"),
    Entry("f37_permutation_importance", permutation),
    Entry("f27_forward_choice", forward),
    Entry("f41_forest_sweep", sweep, _sweep_sql()),
    Entry("f26_coefficients", coefficients),
    Entry("f20_calibrated", calibrated),
    Entry("f23_with_calibration", all_eight),
    Entry("f39_nested_validation", nested),
    Entry("f39_nested_outcomes", nested_outcomes),
    Entry("d06_detection", detection),
    Entry("h24_descriptions", descriptions, f"""WITH {I.ITEM_SEGMENTS}, x AS (SELECT l.*, CASE WHEN n_peaks >= 3 AND diff_peaks <= 2 THEN 'intermittent_spikes' WHEN diff_peaks >= 10 THEN 'high_freq_jitter'
     WHEN n_peaks <= 1 AND diff2_peaks <= 5 THEN 'low_activity' ELSE 'unusual_shapes' END AS shape FROM labelled l)
     SELECT segment, '检测到' || channel || '通道异常; 异常类型: ' || shape || '（' || CASE shape WHEN 'intermittent_spikes' THEN '间歇性尖峰（孤立脉冲）' WHEN 'high_freq_jitter' THEN '持续高频抖动' WHEN 'low_activity' THEN '低活动/近静止' ELSE '其他异常形态' END
     || '）; 异常得分: 0.75 (阈值0.25); 标准差: ' || format('{{:.4g}}', std) || '; 峰度: ' || printf('%.3f', kurtosis) || '; 峰值数: ' || printf('%.1f', n_peaks::DOUBLE) || '; 一阶差分峰数: ' || printf('%.1f', diff_peaks::DOUBLE) AS text FROM x"""),
    Entry("h27_evidence", evidence),
]
