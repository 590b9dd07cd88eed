"""Rules, scores, fusion, evaluation over the item segments.

``score`` here is a stand-in that SQL can compute too (mean distance of three features in deviations of the fit rows);
the forest itself is registered apart and checked by row counts and property tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import Entry
from tidemark.catalog import inputs as I
from tidemark.functions import metrics as M
from tidemark.functions.hashing import uniform
from tidemark.operators import evaluate as E
from tidemark.operators import features as X
from tidemark.operators import forest as T
from tidemark.operators import fusion as U
from tidemark.operators import rules as R
from tidemark.operators import sampling as P
from tidemark.operators.quantiles import quantiles
from tidemark.schema import FEATURES

COLS = list(FEATURES)
STRONG = ["AF", "NF", "RF"]
SCORE_COLUMNS = ["mean", "std", "skew"]


def rounded(df, *cols, places=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


def segments(spark, sf):
    return I.stored(spark, sf, "item_segments", lambda: I.item_segments(spark, sf))


def limits_of(rows):
    return R.thresholds(rows.filter("split = 'fit'"), COLS)


def scored(spark, sf, count_mode="feature"):
    return I.stored(spark, sf, f"scored_{count_mode}", lambda: _scored(segments(spark, sf), count_mode))


def _scored(rows, count_mode):
    limits = limits_of(rows)
    hit = R.rule_hits(rows, limits, COLS, count_mode)
    far = 0
    joined = hit.join(R.limits_map(limits), "channel", "left")
    for c in SCORE_COLUMNS:
        t = F.element_at("limits", F.lit(c))
        far = far + F.abs(F.col(c) - t["mean"]) / t["std"]
    return joined.withColumn("score", far / 3.0).select(
        "segment", "channel", "anomaly", "train", "split", "hits", "judged", "score")


def scored_sql(mode="feature"):
    far = " + ".join(f"abs(h.{c} - {c}_t.mean) / {c}_t.std" for c in SCORE_COLUMNS)
    joins = " ".join(f"LEFT JOIN lim {c}_t ON {c}_t.channel = h.channel AND {c}_t.feature = '{c}'" for c in SCORE_COLUMNS)
    return f"""{I.ITEM_SEGMENTS}, fitrows AS (SELECT * FROM labelled WHERE split = 'fit'), {I.thresholds_sql('fitrows', 'lim', COLS)},
{I.hits_sql('labelled', 'lim', 'hit', COLS, mode)},
scored AS (SELECT h.segment, h.channel, h.anomaly, h.train, h.split, h.hits, h.judged, ({far}) / 3.0 AS score FROM hit h {joins})"""


SCORED = scored_sql()

METRICS_SQL = """count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp"""
ALL_SQL = """tn, fp, fn, tp, tn+fp+fn+tp AS n, tp+fn AS n_true, tp+fp AS n_pred, CASE WHEN 2*tp+fp+fn > 0 THEN 2.0*tp/(2.0*tp+fp+fn) ELSE 0.0 END::DOUBLE AS f1,
 CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0.0 END::DOUBLE AS precision, CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0.0 END::DOUBLE AS recall,
 CASE WHEN tn+fp+fn+tp > 0 THEN (tp+tn)/(tn+fp+fn+tp) ELSE 0.0 END::DOUBLE AS accuracy,
 CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp::DOUBLE*tn - fp::DOUBLE*fn)/(sqrt(tp+fp)*sqrt(tp+fn)*sqrt(tn+fp)*sqrt(tn+fn)) ELSE 0.0 END AS mcc,
 CASE WHEN tp+fp > 0 THEN fp/(tp+fp) END::DOUBLE AS false_alarm_ratio, tn+fp+fn+tp < 30 AS small_sample"""
RATES = ["f1", "precision", "recall", "accuracy", "mcc", "false_alarm_ratio"]
RATES_SQL = "* EXCLUDE (" + ", ".join(RATES) + "), " + ", ".join(f"round({c}, 6) AS {c}" for c in RATES)
F1_SQL = "CASE WHEN 2*tp+fp+fn > 0 THEN 2.0*tp/(2.0*tp+fp+fn) ELSE 0.0 END::DOUBLE AS f1"


def metrics_sql(source, group=""):
    g = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return f"(SELECT {g}{ALL_SQL} FROM (SELECT {g}{METRICS_SQL} FROM {source}{tail}))"


def rule_rows(spark, sf, k=2):
    return scored(spark, sf).withColumn("pred", R.rule_prediction(k))


# ---- thresholds and hits

def thresholds(spark, sf):
    return rounded(limits_of(segments(spark, sf)), "mean", "std", "q1", "q3", "iqr")


def thresholds_bracketed(spark, sf):
    """Quartiles by the route for groups too large for one task."""
    tall = R.long_form(segments(spark, sf).filter("split = 'fit'"), ["channel"], COLS)
    return rounded(quantiles(tall, ["channel", "feature"], "value", {"q1": 0.25, "q3": 0.75}, largest=10, small=1), "q1", "q3")


def net_thresholds(spark, sf):
    rows = segments(spark, sf).filter("split = 'fit'")
    return rounded(R.net_thresholds(rows, COLS, min_normals=60), "mean", "std", "q1", "q3", "iqr")


def hits(spark, sf):
    return scored(spark, sf).select("segment", "hits", "judged", R.rule_prediction(2).alias("by_count"),
                                    R.rule_prediction().alias("by_ratio"))


def hits_test_mode(spark, sf):
    return scored(spark, sf, "test").select("segment", "hits", "judged")


def hits_long(spark, sf):
    """The same hit counts through the long form and a shuffle, with the two tests told apart."""
    rows = segments(spark, sf)
    v = R.violations(rows, limits_of(rows), ["segment", "channel"], COLS)
    return v.groupBy("segment").agg(
        F.count_if("sigma_hit").alias("sigma_hits"), F.count_if("iqr_hit").alias("iqr_hits"),
        F.count_if(F.col("sigma_hit") | F.col("iqr_hit")).alias("hits"))


HITS_LONG = f"""WITH {SCORED} SELECT segment, count(*) FILTER (abs(value - t.mean) > 3.0 * t.std) AS sigma_hits,
 count(*) FILTER (value < t.q1 - 1.5 * t.iqr OR value > t.q3 + 1.5 * t.iqr) AS iqr_hits,
 count(*) FILTER (abs(value - t.mean) > 3.0 * t.std OR value < t.q1 - 1.5 * t.iqr OR value > t.q3 + 1.5 * t.iqr) AS hits
 FROM hit_tall v JOIN lim t USING (channel, feature) GROUP BY 1"""


def choose_k(spark, sf):
    return rounded(R.choose_k(scored(spark, sf).filter("split = 'val'")), "f1")


def choose_k_channel(spark, sf):
    return rounded(R.choose_k(scored(spark, sf).filter("split = 'val'"), ["channel"]), "f1")


def k_sql(group):
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""WITH {SCORED}, g(k) AS (VALUES (1), (2), (3)), v AS (SELECT {g}k, anomaly AS y, CAST(hits >= k AS INTEGER) AS p FROM scored, g WHERE split = 'val'),
m AS (SELECT {g}k, {F1_SQL} FROM (SELECT {g}k, {METRICS_SQL} FROM v GROUP BY ALL))
SELECT {g}k, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, k) AS r FROM m) WHERE r = 1"""


def histogram(spark, sf):
    return rounded(R.hit_histogram(scored(spark, sf)), "f1_at_cut").withColumn("positives", F.col("positives").cast("long"))


def marginal(spark, sf):
    rows = segments(spark, sf)
    d = R.marginal_contribution(rows.filter("split <> 'fit'"), limits_of(rows), ["segment", "channel"], COLS, k=1)
    return rounded(d, "fire_rate", "alone_share", "f1_alone", "f1_drop")


MARGINAL = f"""WITH {SCORED}, fired AS (SELECT DISTINCT segment, feature FROM hit_tall v JOIN lim t USING (channel, feature)
 WHERE abs(value - t.mean) > 3.0 * t.std OR value < t.q1 - 1.5 * t.iqr OR value > t.q3 + 1.5 * t.iqr),
x AS (SELECT s.segment, s.anomaly AS y, s.hits, f.feature, EXISTS (SELECT 1 FROM fired z WHERE z.segment = s.segment AND z.feature = f.feature) AS v
 FROM scored s, (SELECT unnest({COLS}) AS feature) f WHERE split <> 'fit'),
c AS (SELECT feature, avg(CAST(v AS INTEGER)) AS fire_rate, avg(CAST(hits = 1 AS INTEGER)) FILTER (v) AS alone_share,
 count(*) FILTER (v AND y = 1) AS atp, count(*) FILTER (v AND y = 0) AS afp, count(*) FILTER (NOT v AND y = 1) AS afn,
 count(*) FILTER (hits >= 1 AND y = 1) AS btp, count(*) FILTER (hits >= 1 AND y = 0) AS bfp, count(*) FILTER (hits < 1 AND y = 1) AS bfn,
 count(*) FILTER (hits >= 1 AND NOT (v AND hits = 1) AND y = 1) AS dtp, count(*) FILTER (hits >= 1 AND NOT (v AND hits = 1) AND y = 0) AS dfp,
 count(*) FILTER (NOT (hits >= 1 AND NOT (v AND hits = 1)) AND y = 1) AS dfn FROM x GROUP BY 1)
SELECT feature, round(fire_rate, 6) AS fire_rate, round(alone_share, 6) AS alone_share,
 round(CASE WHEN 2*atp+afp+afn > 0 THEN 2*atp/(2*atp+afp+afn) ELSE 0 END::DOUBLE, 6) AS f1_alone,
 round(CASE WHEN 2*dtp+dfp+dfn > 0 THEN 2*dtp/(2*dtp+dfp+dfn) ELSE 0 END::DOUBLE - CASE WHEN 2*btp+bfp+bfn > 0 THEN 2*btp/(2*btp+bfp+bfn) ELSE 0 END::DOUBLE, 6) AS f1_drop FROM c"""


# ---- evaluation

def evaluation(spark, sf):
    return rounded(E.evaluate_with_total(rule_rows(spark, sf).filter("split = 'test'")), *RATES)


EVALUATION = f"""WITH {SCORED}, v AS (SELECT channel, anomaly AS y, CAST(hits >= 2 AS INTEGER) AS p FROM scored WHERE split = 'test')
SELECT {RATES_SQL} FROM (SELECT channel, {ALL_SQL} FROM (SELECT channel, {METRICS_SQL} FROM v GROUP BY GROUPING SETS ((channel), ())))"""


def poisson_sql(u):
    total, term, parts = 0.0, 0.36787944117144233, []
    for k in range(9):
        total += term
        parts.append(f"WHEN {u} < {total!r}::DOUBLE THEN {k}")
        term /= k + 1
    return "CASE " + " ".join(parts) + " ELSE 9 END"


def bootstrap(spark, sf):
    d = E.bootstrap_f1(rule_rows(spark, sf), "segment")
    return rounded(d, "f1_low", "f1_high")


BOOT_ROWS = f"""draws AS (SELECT segment, anomaly AS y, hits, score, r, {poisson_sql(I.u_sql_tag('segment', "'42:' || CAST(r AS VARCHAR)"))} AS w
 FROM scored, (SELECT unnest(range(1, 1001)) AS r))"""


def weighted_f1_sql(flag):
    return (f"CASE WHEN 2*sum(w) FILTER (y = 1 AND {flag}) + sum(w) FILTER (y = 0 AND {flag}) + sum(w) FILTER (y = 1 AND NOT ({flag})) > 0 THEN "
            f"2.0 * sum(w) FILTER (y = 1 AND {flag}) / (2.0*sum(w) FILTER (y = 1 AND {flag}) + coalesce(sum(w) FILTER (y = 0 AND {flag}), 0) + coalesce(sum(w) FILTER (y = 1 AND NOT ({flag})), 0)) ELSE 0.0 END::DOUBLE")


def paired(spark, sf):
    rows = scored(spark, sf).withColumn("a", R.rule_prediction(1)).withColumn("b", R.rule_prediction(2))
    d = E.paired_bootstrap(rows, "segment", "a", "b")
    return rounded(d, "delta_low", "delta_high", "delta_mean", "p_gain")


def verdict_table(spark, sf):
    rows = rule_rows(spark, sf).withColumn("wide", R.rule_prediction(1))
    d = E.contribution_verdict(E.evaluate(rows, "pred", group=["channel"]), E.evaluate(rows, "wide", group=["channel"]))
    return rounded(d, "f1_base", "f1_other", "delta")


VERDICT = f"""WITH {SCORED}, a AS (SELECT channel, anomaly AS y, CAST(hits >= 2 AS INTEGER) AS p FROM scored), b AS (SELECT channel, anomaly AS y, CAST(hits >= 1 AS INTEGER) AS p FROM scored),
x AS (SELECT a.channel, a.n, a.f1 AS f1_base, b.f1 AS f1_other, b.f1 - a.f1 AS delta FROM {metrics_sql('a', 'channel')} a JOIN {metrics_sql('b', 'channel')} b USING (channel))
SELECT channel, n, round(f1_base, 6) AS f1_base, round(f1_other, 6) AS f1_other, round(delta, 6) AS delta, CASE WHEN n < 30 THEN 'small_n_not_significant'
 WHEN delta > 1e-9 THEN 'positive' WHEN delta < -1e-9 THEN 'negative' ELSE 'neutral' END AS verdict FROM x"""


def leave_one(spark, sf):
    return rounded(E.without_group(rule_rows(spark, sf), "AF"), *RATES)


LEAVE_ONE = f"""WITH {SCORED}, v AS (SELECT 'all' AS mode, anomaly AS y, CAST(hits >= 2 AS INTEGER) AS p FROM scored UNION ALL
 SELECT 'without', anomaly, CASE WHEN channel = 'AF' THEN 0 ELSE CAST(hits >= 2 AS INTEGER) END FROM scored)
SELECT {RATES_SQL} FROM {metrics_sql('v', 'mode')}"""


def auc(spark, sf):
    tall = R.long_form(segments(spark, sf), ["anomaly"], COLS)
    d = E.auc(tall, ["feature"])
    return rounded(d.withColumn("positives", F.col("positives").cast("long")), "auc")


AUC = f"""{I.ITEM_SEGMENTS}, tall AS (UNPIVOT (SELECT anomaly, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in COLS)} FROM labelled) ON {', '.join(COLS)} INTO NAME feature VALUE value),
rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM tall),
aucs AS (SELECT feature, count(*) AS n, CAST(sum(anomaly) AS BIGINT) AS positives, CAST((sum(r) FILTER (anomaly = 1) - sum(anomaly) * (sum(anomaly) + 1) / 2.0) / (sum(anomaly) * (count(*) - sum(anomaly))) AS DOUBLE) AS auc FROM rk GROUP BY 1)"""


def whitelist(spark, sf):
    tall = R.long_form(segments(spark, sf), ["anomaly"], COLS)
    d = U.whitelist(E.auc(tall, ["feature"]), COLS, n=6)
    return rounded(d, "auc", "strength").withColumn("rank", F.col("rank").cast("long"))


WHITELIST = f"""WITH {AUC}, s AS (SELECT feature, auc, abs(auc - 0.5) AS strength, list_position({COLS}, feature)::BIGINT AS place FROM aucs),
k AS (SELECT *, row_number() OVER (ORDER BY strength DESC, feature) AS rank FROM s)
SELECT feature, round(auc, 6) AS auc, round(strength, 6) AS strength, place, rank FROM k WHERE rank <= 6"""


def split_census(spark, sf):
    return rounded(P.split_census(segments(spark, sf), 0.2), "rate")


def channel_census(spark, sf):
    return P.channel_census(segments(spark, sf))


def determinism(spark, sf):
    """Hits from shuffled input against hits from the table as it lies; no row may differ."""
    rows = segments(spark, sf)
    mixed = rows.repartition(7, "top").sortWithinPartitions(F.desc("top"))
    a = R.rule_hits(rows, limits_of(rows), COLS).select("segment", "hits")
    b = R.rule_hits(mixed, limits_of(mixed), COLS).select("segment", "hits")
    return E.tables_differ(a, b).agg(F.count(F.lit(1)).alias("differing"))


# ---- contamination, fusion

GRID_VALUES = ", ".join(f"({c}::DOUBLE)" for c in T.GRID)


def contamination_sql(source="fitrows_s", out="climits"):
    probs = "[" + ", ".join(repr(1.0 - c) for c in T.GRID) + "]"
    cs = "[" + ", ".join(f"{c}::DOUBLE" for c in T.GRID) + "]"
    return f"""{source} AS (SELECT * FROM scored WHERE split = 'fit'),
{out} AS (SELECT channel, unnest({cs}) AS c, unnest(quantile_cont(score, {probs})) AS threshold FROM {source} GROUP BY channel)"""


SWEEP_SQL = f"""{contamination_sql()}, tried AS (SELECT v.channel, l.c, v.anomaly AS y, CAST(v.score > l.threshold AS INTEGER) AS p FROM scored v JOIN climits l USING (channel) WHERE v.split = 'val'),
swept AS (SELECT channel, c, {F1_SQL} FROM (SELECT channel, c, {METRICS_SQL} FROM tried GROUP BY ALL)),
enough AS (SELECT channel, count(*) FILTER (split = 'fit') AS n_fit, count(*) FILTER (split = 'val') AS n_eval FROM scored WHERE split <> 'test' GROUP BY 1),
chosen AS (SELECT e.channel, n_fit, n_eval, CASE WHEN n_fit >= 10 AND n_eval >= 5 THEN c END AS c, CASE WHEN n_fit >= 10 AND n_eval >= 5 THEN f1 END AS f1
 FROM enough e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY f1 DESC, c) AS r FROM swept) WHERE r = 1) USING (channel))"""
PREDICTED_SQL = f"""{SWEEP_SQL}, predicted AS (SELECT s.*, CAST(s.hits >= 2 AS INTEGER) AS rule_pred, coalesce(CAST(s.score > l.threshold AS INTEGER), 0) AS if_pred, s.score - l.threshold AS margin
 FROM scored s LEFT JOIN chosen c ON c.channel = s.channel LEFT JOIN climits l ON l.channel = c.channel AND l.c = c.c)"""
NORM_SQL = """norm AS (SELECT p.*, least(greatest((hits - h0) / (CASE WHEN h1 <= h0 THEN h0 + 1.0 ELSE h1 END - h0), 0.0), 1.0)::DOUBLE AS hits_norm,
 coalesce(least(greatest(CASE WHEN s1 - s0 > 0 THEN (score - s0) / (s1 - s0) ELSE 0.0 END, 0.0), 1.0), 0.0)::DOUBLE AS score_norm
 FROM predicted p LEFT JOIN (SELECT channel, min(score) AS s0, max(score) AS s1 FROM scored WHERE split = 'fit' GROUP BY 1) USING (channel),
 (SELECT min(hits) AS h0, max(hits) AS h1 FROM scored WHERE split = 'fit'))"""


def predicted(spark, sf):
    return I.stored(spark, sf, "predicted", lambda: _predicted(scored(spark, sf)))


def _predicted(rows):
    rows = rows.withColumn("rule_pred", R.rule_prediction(2))
    fit, val = rows.filter("split = 'fit'"), rows.filter("split = 'val'")
    limits = T.contamination_thresholds(fit)
    return U.forest_prediction(rows, limits, U.choose_contamination(fit, val))


def c_thresholds(spark, sf):
    return rounded(T.contamination_thresholds(scored(spark, sf).filter("split = 'fit'")), "threshold")


def c_scale(spark, sf):
    return rounded(T.display_scale(scored(spark, sf).filter("split = 'fit'")), "tau95", "score_std")


def c_sweep(spark, sf):
    rows = scored(spark, sf)
    d = U.contamination_sweep(rows.filter("split = 'fit'"), rows.filter("split = 'val'"), per_group=False)
    return rounded(d, *RATES)


def c_choice(spark, sf):
    rows = scored(spark, sf)
    return rounded(U.choose_contamination(rows.filter("split = 'fit'"), rows.filter("split = 'val'")), "f1")


def combos(spark, sf):
    d = U.with_combinations(predicted(spark, sf))
    return d.groupBy("channel").agg(*[F.sum(f"pred_{o}").cast("long").alias(f"n_{o.lower()}") for o in U.OPERATORS])


def normalised(spark, sf):
    return rounded(U.normalise(predicted(spark, sf)).select("segment", "hits_norm", "score_norm"), "hits_norm", "score_norm")


def soft_sql(group):
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    ws = ", ".join(f"({w}::DOUBLE)" for w in U.WEIGHTS)
    ts = ", ".join(f"({t}::DOUBLE)" for t in U.TAUS)
    return f"""softgrid AS (SELECT {g}weight, tau, {F1_SQL} FROM (SELECT {g}weight, tau, {METRICS_SQL} FROM (SELECT {g}weight, tau, anomaly AS y,
 CAST(weight * score_norm + (1.0::DOUBLE - weight) * hits_norm >= tau AS INTEGER) AS p FROM norm, (VALUES {ws}) w(weight), (VALUES {ts}) t(tau) WHERE split = 'val') GROUP BY ALL)),
softbest AS (SELECT {g}weight, tau, f1 FROM (SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, weight, tau) AS r FROM softgrid) WHERE r = 1)"""


def soft_global(spark, sf):
    return rounded(U.choose_soft(U.normalise(predicted(spark, sf)).filter("split = 'val'")), "f1")


def soft_channel(spark, sf):
    return rounded(U.choose_soft(U.normalise(predicted(spark, sf)).filter("split = 'val'"), ["channel"]), "f1")


def gate(spark, sf):
    return rounded(U.choose_gate(predicted(spark, sf).filter("split = 'val'")), "f1")


def ops_sql(split, out):
    return f"""{out} AS (SELECT channel, pos, op, tn, fp, fn, tp, {F1_SQL} FROM (SELECT channel, pos, op, {METRICS_SQL} FROM (
 SELECT channel, anomaly AS y, unnest([0, 1, 2, 3]) AS pos, unnest(['rule', 'if', 'AND', 'OR']) AS op,
 unnest([rule_pred, if_pred, least(rule_pred, if_pred), greatest(rule_pred, if_pred)]) AS p FROM predicted WHERE split = '{split}') GROUP BY ALL))"""


GATE_SQL = f"{ops_sql('val', 'valops')}, gate AS (SELECT channel, op, f1 FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY f1 DESC, pos) AS r FROM valops) WHERE r = 1)"


def all_strategies(spark, sf):
    rows = U.normalise(predicted(spark, sf))
    val = rows.filter("split = 'val'")
    rows = U.with_combinations(rows)
    rows = U.apply_soft(rows, U.choose_soft(val), out="soft_all")
    rows = U.apply_soft(rows, U.choose_soft(val, ["channel"]), ["channel"], out="soft_channel")
    return U.apply_gate(rows, U.choose_gate(val), out="gate")


STRATEGY_NAMES = {"rule_only": "pred_rule", "if_only": "pred_if", "if_and_rule": "pred_AND", "if_or_rule": "pred_OR",
             "soft_global": "soft_all", "soft_perchannel": "soft_channel", "gate_perchannel": "gate"}


def strategies(spark, sf):
    return rounded(U.strategy_table(all_strategies(spark, sf).filter("split <> 'fit'"), STRATEGY_NAMES), *RATES)


STRATEGIES = f"""WITH {SCORED}, {PREDICTED_SQL}, {NORM_SQL}, {soft_sql('')}, {soft_sql('channel').replace('softgrid', 'cgrid').replace('softbest', 'cbest')}, {GATE_SQL},
flat AS (SELECT split, anomaly AS y, unnest(range(7)) AS pos, unnest(['rule_only', 'if_only', 'if_and_rule', 'if_or_rule', 'soft_global', 'soft_perchannel', 'gate_perchannel']) AS strategy,
 unnest([rule_pred, if_pred, least(rule_pred, if_pred), greatest(rule_pred, if_pred),
 CAST(b.weight * score_norm + (1.0::DOUBLE - b.weight) * hits_norm >= b.tau AS INTEGER), CAST(c.weight * score_norm + (1.0::DOUBLE - c.weight) * hits_norm >= c.tau AS INTEGER),
 CASE g.op WHEN 'rule' THEN rule_pred WHEN 'if' THEN if_pred WHEN 'AND' THEN least(rule_pred, if_pred) WHEN 'OR' THEN greatest(rule_pred, if_pred) ELSE 0 END]) AS p
 FROM norm n LEFT JOIN cbest c ON c.channel = n.channel LEFT JOIN gate g ON g.channel = n.channel, softbest b WHERE split <> 'fit'),
m AS {metrics_sql('flat', 'pos, strategy, split')}, best AS (SELECT strategy AS bs FROM m WHERE split = 'val' ORDER BY f1 DESC, pos LIMIT 1)
SELECT {RATES_SQL.replace('EXCLUDE (', 'EXCLUDE (pos, bs, ')}, strategy = bs AS best FROM m, best"""


def ties(spark, sf):
    rows = predicted(spark, sf)
    d = U.tie_enumeration(rows.filter("split = 'val'"), rows.filter("split = 'test'"))
    return rounded(U.distribution(d, "f1", F.lit(0.3)), "q00", "q10", "q25", "q50", "q75", "q90", "q100", "share_below")


TIES = f"""WITH RECURSIVE {SCORED}, {PREDICTED_SQL}, {ops_sql('val', 'valops')}, {ops_sql('test', 'testops')},
tied AS (SELECT v.channel, v.op, t.tp, t.fp, t.fn, dense_rank() OVER (ORDER BY v.channel) AS k FROM (SELECT *, max(f1) OVER (PARTITION BY channel) AS b FROM valops) v
 JOIN testops t ON t.channel = v.channel AND t.op = v.op WHERE b - v.f1 < 1e-12),
walk AS (SELECT 0::BIGINT AS k, 0::BIGINT AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn UNION ALL SELECT t.k, w.tp + t.tp, w.fp + t.fp, w.fn + t.fn FROM walk w JOIN tied t ON t.k = w.k + 1),
f AS (SELECT {F1_SQL} FROM walk WHERE k = (SELECT max(k) FROM tied))
SELECT round(min(f1), 6) AS q00, round(quantile_cont(f1, 0.1), 6) AS q10, round(quantile_cont(f1, 0.25), 6) AS q25, round(quantile_cont(f1, 0.5), 6) AS q50,
 round(quantile_cont(f1, 0.75), 6) AS q75, round(quantile_cont(f1, 0.9), 6) AS q90, round(max(f1), 6) AS q100, count(DISTINCT round(f1, 6)) AS distinct_values,
 round(avg(CASE WHEN f1 < 0.3 - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS share_below FROM f"""


def fallback(spark, sf):
    rows = predicted(spark, sf)
    val = rows.filter("split = 'val'")
    census = val.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("anomaly").alias("positives"))
    return rounded(U.fallback_gate(U.choose_gate(val), census, min_rows=16, min_positives=3), "f1")


FALLBACK = f"""WITH {SCORED}, {PREDICTED_SQL}, {GATE_SQL}, c AS (SELECT channel, count(*) AS n, sum(anomaly) AS p FROM scored WHERE split = 'val' GROUP BY 1)
SELECT channel, CASE WHEN coalesce(n, 0) < 16 OR coalesce(p, 0) < 3 THEN 'rule' ELSE op END AS op, round(f1, 6) AS f1, (coalesce(n, 0) < 16 OR coalesce(p, 0) < 3) AS fell_back
FROM gate LEFT JOIN c USING (channel)"""


def one_operator(spark, sf):
    return rounded(U.global_operator(predicted(spark, sf).filter("split = 'val'")), "f1")


ONE_OPERATOR = f"""WITH {SCORED}, {PREDICTED_SQL}, {ops_sql('val', 'valops')}, t AS (SELECT pos, op, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM valops GROUP BY 1, 2)
SELECT op, round({F1_SQL.replace(' AS f1', '')}, 6) AS f1 FROM t ORDER BY {F1_SQL.replace(' AS f1', '')} DESC, pos LIMIT 1"""


def scheme(spark, sf):
    """Strong channels by forest OR rule, weak ones by the global cut, once with three and once with all channels strong."""
    rows = predicted(spark, sf)
    cut = quantiles(rows.filter("split = 'fit'").withColumn("one", F.lit(1)), ["one"], "score", {"cut": 0.75})
    rows = rows.join(F.broadcast(cut.select("cut"))).withColumn("global_pred", (F.col("score") > F.col("cut")).cast("int"))
    three = U.strong_weak(rows, STRONG).withColumn("scheme", F.lit("three"))
    every = U.strong_weak(rows, ["AF", "AO", "NF", "NO", "RF", "RO"]).withColumn("scheme", F.lit("every"))
    return rounded(E.evaluate(three.unionByName(every), group=["scheme"]), *RATES)


SCHEME = f"""WITH {SCORED}, {PREDICTED_SQL}, z AS (SELECT *, CAST(score > (SELECT quantile_cont(score, 0.75) FROM scored WHERE split = 'fit') AS INTEGER) AS gp FROM predicted),
v AS (SELECT 'three' AS scheme, anomaly AS y, CASE WHEN channel IN ('AF', 'NF', 'RF') THEN greatest(rule_pred, if_pred) ELSE gp END AS p FROM z
 UNION ALL SELECT 'every', anomaly, greatest(rule_pred, if_pred) FROM z) SELECT {RATES_SQL} FROM {metrics_sql('v', 'scheme')}"""


def stage2(spark, sf):
    rows = scored(spark, sf, "test").withColumn("rule_pred", R.rule_prediction(2))
    fit = rows.filter("split = 'fit'")
    cut = T.contamination_thresholds(fit, [0.2]).select("channel", "threshold")
    scale = T.display_scale(fit.join(cut, "channel").withColumn("score", F.col("score") - F.col("threshold")))
    rows = rows.join(cut, "channel", "left").join(scale, "channel", "left").withColumn("margin", F.col("score") - F.col("threshold"))
    d = U.verdicts(rows, STRONG)
    return rounded(d.select("segment", "hits", "if_flag", "rule_flag", "is_anomaly", "severity", "raw_score", "anomaly_score"), "raw_score")


STAGE2 = f"""WITH {scored_sql('test')}, cut AS (SELECT channel, quantile_cont(score, 0.8) AS threshold FROM scored WHERE split = 'fit' GROUP BY 1),
sc AS (SELECT channel, quantile_cont(score - threshold, 0.95) AS tau95, CASE WHEN stddev_pop(score - threshold) > 0 THEN stddev_pop(score - threshold) ELSE 1.0 END AS sd FROM scored JOIN cut USING (channel) WHERE split = 'fit' GROUP BY 1),
z AS (SELECT s.*, score - threshold AS margin, tau95, sd, channel IN ('AF', 'NF', 'RF') AS strong FROM scored s JOIN cut USING (channel) JOIN sc USING (channel)),
y AS (SELECT *, CASE WHEN strong THEN margin > 0 END AS if_flag, hits >= 2 AS rule_flag, CASE WHEN strong THEN margin > 0 OR hits >= 2 ELSE hits >= 2 END AS is_anomaly FROM z)
SELECT segment, hits, if_flag, rule_flag, is_anomaly, CASE WHEN NOT is_anomaly THEN 'nominal' WHEN strong AND if_flag AND rule_flag THEN 'critical' WHEN strong THEN 'warning'
 WHEN hits >= 4 THEN 'critical' WHEN hits = 3 THEN 'warning' ELSE 'caution' END AS severity, round(CASE WHEN strong THEN margin ELSE hits::DOUBLE END, 6) AS raw_score,
 round(least(CASE WHEN strong THEN greatest(margin - tau95, 0.0) / (3.0 * sd) ELSE hits / 6.0 END, 1.0), 4)::DOUBLE AS anomaly_score FROM y"""


def rollup(spark, sf):
    rows = predicted(spark, sf)
    rows = U.apply_gate(rows, U.choose_gate(rows.filter("split = 'val'")))
    return rounded(U.segment_rollup(rows.filter("split = 'test'"), excluded=["RO"]), "anomaly_score")


ROLLUP = f"""WITH {SCORED}, {PREDICTED_SQL}, {GATE_SQL}, z AS (SELECT p.*, CASE g.op WHEN 'rule' THEN rule_pred WHEN 'if' THEN if_pred WHEN 'AND' THEN least(rule_pred, if_pred) WHEN 'OR' THEN greatest(rule_pred, if_pred) ELSE 0 END AS pred
 FROM predicted p LEFT JOIN gate g USING (channel) WHERE split = 'test'),
s AS (SELECT segment, channel, anomaly AS y_true, CASE WHEN pred = 1 THEN 0.7 + 0.3 * hits / greatest(judged, 1) ELSE 0.3 * hits / greatest(judged, 1) END::DOUBLE AS c FROM z)
SELECT segment, channel, y_true, 1::BIGINT AS n_rows, round(CASE WHEN channel = 'RO' THEN 0.0 ELSE c END, 6)::DOUBLE AS anomaly_score, channel <> 'RO' AND c >= 0.25 AS is_anomaly FROM s"""


def votes(spark, sf):
    rows = predicted(spark, sf)
    rows = U.apply_gate(rows, U.choose_gate(rows.filter("split = 'val'")))
    return rounded(U.vote_sweep(U.segment_rollup(rows.filter("split = 'val'"))).select("tau", "tp", "fp", "fn", "tn", "f1"), "f1")


VOTES = f"""WITH {SCORED}, {PREDICTED_SQL}, {GATE_SQL}, z AS (SELECT p.*, CASE g.op WHEN 'rule' THEN rule_pred WHEN 'if' THEN if_pred WHEN 'AND' THEN least(rule_pred, if_pred) WHEN 'OR' THEN greatest(rule_pred, if_pred) ELSE 0 END AS pred
 FROM predicted p LEFT JOIN gate g USING (channel) WHERE split = 'val'),
s AS (SELECT tau, anomaly AS y, CAST(CASE WHEN pred = 1 THEN 0.7 + 0.3 * hits / greatest(judged, 1) ELSE 0.3 * hits / greatest(judged, 1) END::DOUBLE >= tau AS INTEGER) AS p
 FROM z, (VALUES {', '.join(f'({t}::DOUBLE)' for t in U.VOTE_GRID)}) t(tau))
SELECT tau, tp, fp, fn, tn, round({F1_SQL.replace(' AS f1', '')}, 6) AS f1 FROM (SELECT tau, {METRICS_SQL} FROM s GROUP BY 1)"""


def guard(spark, sf):
    rows = scored(spark, sf)
    fit, val = rows.filter("split = 'fit'"), rows.filter("split = 'val'")
    rule = E.evaluate(val.withColumn("pred", R.rule_prediction(2)), group=["channel"])
    return rounded(U.guard_report(rule, U.contamination_sweep(fit, val)), "rule_f1", "best_forest_f1", "advantage")


GUARD = f"""WITH {SCORED}, {SWEEP_SQL}, v AS (SELECT channel, anomaly AS y, CAST(hits >= 2 AS INTEGER) AS p FROM scored WHERE split = 'val'),
b AS (SELECT channel, max(f1) AS bf FROM swept GROUP BY 1) SELECT channel, round(m.f1, 6) AS rule_f1, round(bf, 6) AS best_forest_f1, round(m.f1 - bf, 6) AS advantage
FROM {metrics_sql('v', 'channel')} m JOIN b USING (channel)"""


def rank_shift(spark, sf):
    rows = U.with_combinations(predicted(spark, sf))
    names = {o: f"pred_{o}" for o in U.OPERATORS}
    table = U.strategy_table(rows.filter("split <> 'fit'"), names)
    d = U.rank_shift(table.filter("split = 'val'"), table.filter("split = 'test'"))
    return rounded(d, "f1_a", "f1_b")


RANK_SHIFT = f"""WITH {SCORED}, {PREDICTED_SQL}, {ops_sql('val', 'valops')}, {ops_sql('test', 'testops')},
a AS (SELECT op AS strategy, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM valops GROUP BY 1), b AS (SELECT op AS strategy, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM testops GROUP BY 1),
ra AS (SELECT strategy, f1, rank() OVER (ORDER BY f1 DESC) AS r FROM (SELECT strategy, {F1_SQL} FROM a)), rb AS (SELECT strategy, f1, rank() OVER (ORDER BY f1 DESC) AS r FROM (SELECT strategy, {F1_SQL} FROM b))
SELECT strategy, round(ra.f1, 6) AS f1_a, ra.r AS rank_a, round(rb.f1, 6) AS f1_b, rb.r AS rank_b, ra.r - rb.r AS shift FROM ra JOIN rb USING (strategy)"""


def config_matrix(spark, sf):
    """Rule columns x threshold mode: the configuration is a grouping key over one union of hit tables."""
    rows = segments(spark, sf)
    fit = rows.filter("split = 'fit'")
    parts = None
    for mode, limits in (("all", R.thresholds(fit, COLS)), ("net", R.net_thresholds(fit, COLS, 60))):
        for name, cols in (("full", COLS), ("short", COLS[:5])):
            d = R.rule_hits(rows.filter("split = 'test'"), limits, cols).select(
                F.lit(mode).alias("thresholds"), F.lit(name).alias("columns"), "anomaly", R.rule_prediction(2).alias("pred"))
            parts = d if parts is None else parts.unionByName(d)
    return rounded(E.evaluate(parts, group=["thresholds", "columns"]), *RATES)


MATRIX = f"""WITH {SCORED}, nn AS (SELECT channel, count(*) FILTER (anomaly = 0) AS normals FROM fitrows GROUP BY 1),
netrows AS (SELECT f.* FROM fitrows f JOIN nn USING (channel) WHERE normals < 60 OR anomaly = 0), {I.thresholds_sql('netrows', 'netlim', COLS)},
testrows AS (SELECT * FROM labelled WHERE split = 'test'), {I.hits_sql('testrows', 'lim', 'h1', COLS)}, {I.hits_sql('testrows', 'lim', 'h2', COLS[:5])},
{I.hits_sql('testrows', 'netlim', 'h3', COLS)}, {I.hits_sql('testrows', 'netlim', 'h4', COLS[:5])},
v AS (SELECT 'all' AS thresholds, 'full' AS columns, anomaly AS y, CAST(hits >= 2 AS INTEGER) AS p FROM h1 UNION ALL SELECT 'all', 'short', anomaly, CAST(hits >= 2 AS INTEGER) FROM h2
 UNION ALL SELECT 'net', 'full', anomaly, CAST(hits >= 2 AS INTEGER) FROM h3 UNION ALL SELECT 'net', 'short', anomaly, CAST(hits >= 2 AS INTEGER) FROM h4)
SELECT {RATES_SQL} FROM {metrics_sql('v', 'thresholds, columns')}"""
NET = f"""WITH {I.ITEM_SEGMENTS}, fitrows AS (SELECT * FROM labelled WHERE split = 'fit'), nn AS (SELECT channel, count(*) FILTER (anomaly = 0) AS normals FROM fitrows GROUP BY 1),
netrows AS (SELECT f.* FROM fitrows f JOIN nn USING (channel) WHERE normals < 60 OR anomaly = 0), {I.thresholds_sql('netrows', 'lim', COLS)}
SELECT channel, feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr FROM lim"""

ENTRIES = [
    Entry("f01_thresholds", thresholds, f"WITH {SCORED} SELECT channel, feature, n, round(mean, 6) AS mean, round(std, 6) AS std, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr FROM lim"),
    Entry("f01_thresholds_bracketed", thresholds_bracketed, f"WITH {SCORED} SELECT channel, feature, round(q1, 6) AS q1, round(q3, 6) AS q3 FROM lim"),
    Entry("f02_net_thresholds", net_thresholds, NET),
    Entry("f04_rule_hits", hits, f"WITH {SCORED} SELECT segment, hits, judged, CAST(hits >= 2 AS INTEGER) AS by_count, CAST(hits / greatest(judged, 1) >= 0.2 AS INTEGER) AS by_ratio FROM scored"),
    Entry("f05_rule_hits_per_test", hits_test_mode, f"WITH {scored_sql('test')} SELECT segment, hits, judged FROM scored"),
    Entry("f03_rule_hits_long", hits_long, HITS_LONG),
    Entry("f07_choose_k", choose_k, k_sql("")),
    Entry("f35_choose_k_channel", choose_k_channel, k_sql("channel")),
    Entry("f34_hit_histogram", histogram, f"""WITH {SCORED}, c AS (SELECT hits, count(*) AS n, sum(anomaly)::BIGINT AS positives FROM scored GROUP BY 1)
     SELECT hits, n, positives, round(2.0 * sum(positives) OVER w / (sum(n) OVER w + sum(positives) OVER ()), 6)::DOUBLE AS f1_at_cut FROM c WINDOW w AS (ORDER BY hits DESC)"""),
    Entry("f33_marginal_contribution", marginal, MARGINAL),
    Entry("g05_evaluate_channels", evaluation, EVALUATION),
    Entry("g06_bootstrap_f1", bootstrap, f"""WITH {SCORED}, {BOOT_ROWS}, b AS (SELECT r, {weighted_f1_sql('hits >= 2')} AS f1 FROM draws GROUP BY r)
     SELECT round(quantile_cont(f1, 0.025), 6) AS f1_low, round(quantile_cont(f1, 0.975), 6) AS f1_high, count(f1) AS n_boot FROM b"""),
    Entry("g07_paired_bootstrap", paired, f"""WITH {SCORED}, {BOOT_ROWS}, b AS (SELECT r, {weighted_f1_sql('hits >= 2')} - {weighted_f1_sql('hits >= 1')} AS d FROM draws GROUP BY r)
     SELECT round(quantile_cont(d, 0.025), 6) AS delta_low, round(quantile_cont(d, 0.975), 6) AS delta_high, round(avg(d), 6) AS delta_mean, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS p_gain FROM b"""),
    Entry("g08_contribution_verdict", verdict_table, VERDICT),
    Entry("g12_determinism", determinism, "SELECT 0::BIGINT AS differing"),
    Entry("g15_without_channel", leave_one, LEAVE_ONE),
    Entry("f24_feature_auc", auc, f"WITH {AUC} SELECT feature, n, positives, round(auc, 6) AS auc FROM aucs"),
    Entry("f25_whitelist", whitelist, WHITELIST),
    Entry("e04_split_census", split_census, f"""WITH {I.ITEM_SEGMENTS} SELECT split, count(*) AS n, sum(anomaly)::BIGINT AS positives, round(avg(anomaly), 6) AS rate, abs(avg(anomaly) - 0.2) > 0.01 AS off_target FROM labelled GROUP BY 1"""),
    Entry("e05_channel_census", channel_census, f"""WITH {I.ITEM_SEGMENTS} SELECT channel, {', '.join(f"count(*) FILTER (split = '{s}') AS n_{s}, count(*) FILTER (split = '{s}' AND anomaly = 1) AS pos_{s}" for s in ('fit', 'val', 'test'))} FROM labelled GROUP BY GROUPING SETS ((channel), ())"""),
    Entry("f11_contamination_thresholds", c_thresholds, f"WITH {SCORED}, {contamination_sql()} SELECT channel, c, round(threshold, 6) AS threshold FROM climits"),
    Entry("f12_display_scale", c_scale, f"WITH {SCORED} SELECT channel, round(quantile_cont(score, 0.95), 6) AS tau95, round(stddev_pop(score), 6) AS score_std FROM scored WHERE split = 'fit' GROUP BY 1"),
    Entry("f13_contamination_sweep", c_sweep, f"WITH {SCORED}, {SWEEP_SQL} SELECT {RATES_SQL} FROM {metrics_sql('tried', 'c')}"),
    Entry("f14_contamination_choice", c_choice, f"WITH {SCORED}, {SWEEP_SQL} SELECT channel, n_fit, n_eval, c, round(f1, 6) AS f1 FROM chosen"),
    Entry("f15_normalise", normalised, f"WITH {SCORED}, {PREDICTED_SQL}, {NORM_SQL} SELECT segment, round(hits_norm, 6) AS hits_norm, round(score_norm, 6) AS score_norm FROM norm"),
    Entry("f16_combinations", combos, f"""WITH {SCORED}, {PREDICTED_SQL} SELECT channel, sum(rule_pred)::BIGINT AS n_rule, sum(if_pred)::BIGINT AS n_if, sum(least(rule_pred, if_pred))::BIGINT AS n_and, sum(greatest(rule_pred, if_pred))::BIGINT AS n_or FROM predicted GROUP BY 1"""),
    Entry("f17_soft_global", soft_global, f"WITH {SCORED}, {PREDICTED_SQL}, {NORM_SQL}, {soft_sql('')} SELECT weight, tau, round(f1, 6) AS f1 FROM softbest"),
    Entry("f18_soft_per_channel", soft_channel, f"WITH {SCORED}, {PREDICTED_SQL}, {NORM_SQL}, {soft_sql('channel')} SELECT channel, weight, tau, round(f1, 6) AS f1 FROM softbest"),
    Entry("f19_gate", gate, f"WITH {SCORED}, {PREDICTED_SQL}, {GATE_SQL} SELECT channel, op, round(f1, 6) AS f1 FROM gate"),
    Entry("f23_strategies", strategies, STRATEGIES),
    Entry("f30_tie_enumeration", ties, TIES),
    Entry("f31_fallback_gate", fallback, FALLBACK),
    Entry("f31_global_operator", one_operator, ONE_OPERATOR),
    Entry("f42_strong_weak_schemes", scheme, SCHEME),
    Entry("f22_stage2_verdicts", stage2, STAGE2),
    Entry("e06_segment_rollup", rollup, ROLLUP),
    Entry("f43_vote_sweep", votes, VOTES),
    Entry("f32_guard_report", guard, GUARD),
    Entry("f40_rank_shift", rank_shift, RANK_SHIFT),
    Entry("f29_configuration_matrix", config_matrix, MATRIX),
]
