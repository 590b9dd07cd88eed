import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import experiments as X
from tidemark.operators import forest as T
from tidemark.operators.evaluate import auc
from tidemark.operators.features import feature_vector

COLS = ["a", "b"]


def planted(spark):
    """Two groups of 300 rows around a point, one in thirty far away."""
    d = spark.range(600).select(F.col("id").alias("segment"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("channel"))
    far = (F.floor(F.col("segment") / 2) % 30 == 7).cast("int")
    return d.withColumn("anomaly", far).withColumn("a", F.sin(F.col("segment")) + far * 6).withColumn(
        "b", F.cos(F.col("segment") * 3.3) - far * 5)


def test_outliers_score_above_inliers(spark):
    d = planted(spark)
    forest = T.fit(d, feature_vector(COLS), trees=40, psi=64)
    scored = T.score(d, forest, feature_vector(COLS))
    assert scored.agg(F.min("score"), F.max("score")).first()[0] > 0
    assert scored.agg(F.max("score")).first()[0] < 1
    for r in auc(scored, ["channel"], "score").collect():
        assert r.auc > 0.99


def test_independent_of_row_order_and_partitions(spark):
    d = planted(spark)
    def run(rows):
        f = T.fit(rows, feature_vector(COLS), trees=10, psi=32)
        return T.score(rows, f, feature_vector(COLS)).select("segment", F.round("score", 12).alias("s"))
    a, b = run(d), run(d.repartition(9, "a").sortWithinPartitions(F.desc("b")))
    assert a.exceptAll(b).count() == 0


def test_pool_bounds_training_and_routes_agree(spark):
    d = planted(spark)
    forest = T.fit(d, feature_vector(COLS), trees=3, psi=16).cache()
    assert forest.count() == 6 and forest.agg(F.max("psi")).first()[0] == 16
    assert forest.agg(F.max(F.size("feature"))).first()[0] <= 31
    a = T.score(d, forest, feature_vector(COLS)).select("segment", F.round("score", 12).alias("s"))
    b = T.score(d, forest, feature_vector(COLS), max_broadcast=1, salts=3).select("segment", F.round("score", 12).alias("s"))
    assert a.exceptAll(b).count() == 0 and b.count() == 600


def test_small_groups_have_no_forest(spark):
    d = planted(spark).withColumn("channel", F.when(F.col("segment") < 9, "tiny").otherwise(F.col("channel")))
    scored = T.score(d, T.fit(d, feature_vector(COLS), trees=3, psi=16), feature_vector(COLS))
    assert scored.filter("score IS NULL").select("channel").distinct().collect()[0].channel == "tiny"


def test_importance_finds_the_informative_feature(spark):
    d = planted(spark).withColumn("noise", F.sin(F.col("segment") * 17.1))

    def predict(rows):
        return rows.withColumn("pred", (F.col("a") > 3).cast("int"))

    got = {r.feature: r.mean_drop for r in X.permutation_importance(d, ["a", "noise"], predict, repeats=3).collect()}
    assert got["a"] > 0.5 and abs(got["noise"]) < 1e-12


def test_average_path():
    assert T.average_path(1) == 0.0 and T.average_path(2) == 1.0
    assert abs(T.average_path(256) - 10.2448) < 1e-3


def test_a_larger_forest_holds_the_smaller_ones(spark):
    """One fit with sizes and subsamples as keys, one descent for all sizes, against forests fitted apart."""
    d = planted(spark)
    vector = feature_vector(COLS)
    keyed = d.select("segment", "anomaly", F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(t).alias("trees"), F.lit(p).alias("psi")) for s, t, p in (("big", 30, 32), ("small", 10, 16))])).alias("s"),
                     *COLS).select("segment", "anomaly", "s.*", *COLS)
    forest = T.fit(keyed, vector, "segment", "setting", F.col("trees"), F.col("psi")).cache()
    assert {(r.grp, r["count"]) for r in forest.groupBy("grp").count().collect()} == {("big", 30), ("small", 10)}
    got = T.scores_by_size(keyed.drop("trees", "psi").withColumn("x", vector), forest, F.col("x"), "setting", [10, 30], salts=3)
    assert got.groupBy("setting", "trees").count().count() == 3
    for setting, trees in (("big", 10), ("big", 30), ("small", 10)):
        one = forest.filter((F.col("grp") == setting) & (F.col("tree") < trees)).withColumn("grp", F.lit("*"))
        want = T.score(d, one, vector, None).select("segment", F.round("score", 12).alias("s"))
        have = got.filter((F.col("setting") == setting) & (F.col("trees") == trees)).select("segment", F.round("score", 12).alias("s"))
        assert have.exceptAll(want).count() == 0 and have.count() == 600


def test_sweep_and_forward_choice_find_the_planted_columns(spark):
    d = planted(spark).withColumn("noise", F.sin(F.col("segment") * 17.1)).withColumn("split", F.when(F.floor(F.col("segment") / 60) % 2 == 0, "fit").when(F.col("segment") % 2 == 0, "val").otherwise("test"))
    fit, held = d.filter("split = 'fit'"), d.filter("split <> 'fit'")
    got = X.forest_sweep(fit, held, {"all": {"trees": 40, "psi": 64}, "noise": {"trees": 10, "columns": ["noise"]}}, ["a", "b", "noise"], [10, 40])
    rows = {(r.setting, r.trees, r.split): r.auc for r in got.collect()}
    assert set(rows) == {("all", n, s) for n in (10, 40) for s in ("val", "test")} | {("noise", 10, s) for s in ("val", "test")}
    assert all(a > 0.75 for (s, *_), a in rows.items() if s == "all") and rows[("noise", 10, "val")] < rows[("all", 40, "val")] - 0.1
    path = X.forward_choice(fit, d.filter("split = 'val'"), ["noise", "a", "b"], steps=3, trees=20, psi=64).collect()
    assert path[0].feature in ("a", "b") and path[0].auc > 0.95 and path[0].f1 > 0.5 and path[0].contamination in T.GRID


def test_nested_validation_against_plain_loops(spark):
    """Every pick of every repeat, recomputed row by row from forests of the same names."""
    from tidemark.functions.hashing import uniform
    from tidemark.operators import rules as R

    cols, repeats, trees, psi = ["a", "b", "noise"], 3, 4, 32
    d = planted(spark).withColumn("noise", F.sin(F.col("segment") * 17.1)).withColumn("a", F.col("a") + F.cos(F.col("segment") * 1.7) * 3)
    fit, val = d.filter("segment % 5 < 2"), d.filter("segment % 5 = 3")
    got = {r.repeat: r for r in X.nested_validation(fit, val, cols, repeats, 3, trees, psi).collect()}
    rows = val.select("segment", "channel", "anomaly", *[uniform(F.col("segment"), f"half{r}").alias(f"u{r}") for r in range(1, repeats + 1)]).collect()
    scores = {}

    def score_of(subset):
        if subset not in scores:
            v = feature_vector(list(subset))
            name = "+".join(subset)
            whole = T.score(val, T.fit(fit.withColumn("s", F.lit(name)), v, group="s", trees=trees, psi=psi).withColumn("grp", F.lit("*")), v, None)
            cell = F.concat_ws("|", F.lit(name), "channel")
            own = T.fit(fit.withColumn("cell", cell), v, group="cell", trees=trees, psi=psi).cache()
            cuts = {(r.cell, r.c): r.threshold for r in T.contamination_thresholds(T.score(fit.withColumn("cell", cell), own, v, "cell"), group="cell").collect()}
            by = {r.segment: r.score for r in T.score(val.withColumn("cell", cell), own, v, "cell").collect()}
            hits = {r.segment: r.hits for r in R.rule_hits(val, R.thresholds(fit, list(subset)), list(subset)).collect()}
            scores[subset] = ({r.segment: r.score for r in whole.collect()}, by, {(c.split("|")[1], x): t for (c, x), t in cuts.items()}, hits)
        return scores[subset]

    def area(part, s):
        pos, neg = ([s[r.segment] for r in part if r.anomaly == y] for y in (1, 0))
        return round(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)), 9) if pos and neg else 0.5

    def f1(y, p):
        tp, miss = sum(a and b for a, b in zip(y, p)), sum(a != b for a, b in zip(y, p))
        return 2 * tp / (2 * tp + miss) if tp + miss else 0.0

    for r in range(1, repeats + 1):
        a, b = ([x for x in rows if (x[f"u{r}"] < 0.5) == first] for first in (False, True))
        chosen, best = [], -1.0
        while len(chosen) < 3:
            tried = [(-area(a, score_of(tuple(sorted([*chosen, c], key=cols.index)))[0]), c) for c in cols if c not in chosen]
            top = min(tried)
            if chosen and -top[0] <= best + 1e-6:
                break
            best, chosen = -top[0], [*chosen, top[1]]
        subset = tuple(sorted(chosen, key=cols.index))
        assert got[r].subset == "+".join(subset)
        _, by, cuts, hits = score_of(subset)
        k = max((1, 2, 3, 4), key=lambda k: (f1([x.anomaly for x in a], [hits[x.segment] >= k for x in a]), -k))
        assert got[r].k == k

        def ops(x, c):
            rule, strange = hits[x.segment] >= k, by[x.segment] > cuts[x.channel, c]
            return [rule, strange, rule and strange, rule or strange]
        y, p = [], []
        for channel in "AB":
            own = [x for x in a if x.channel == channel]
            c, o = max(((c, o) for c in T.GRID for o in range(4)), key=lambda t: (f1([x.anomaly for x in own], [ops(x, t[0])[t[1]] for x in own]), -t[0], -t[1]))
            y += [x.anomaly for x in b if x.channel == channel]
            p += [ops(x, c)[o] for x in b if x.channel == channel]
        assert abs(got[r].gate_f1 - f1(y, p)) < 1e-12
        assert abs(got[r].rule_f1 - f1([x.anomaly for x in b], [hits[x.segment] >= k for x in b])) < 1e-12


def test_forests_of_subsets_are_those_of_repeated_rows(spark):
    """Rows are drawn once for all subsets: the trees and scores are the same as of a fit on rows repeated for every subset."""
    d = planted(spark)
    subsets = {"a": [0], "b": [1], "a+b": [0, 1]}
    entry = F.explode(F.array(*[F.struct(F.lit(s).alias("subset"), feature_vector([COLS[i] for i in p]).alias("x")) for s, p in subsets.items()])).alias("s")
    repeated = d.select("segment", "channel", entry).select("segment", "channel", "s.*").withColumn("cell", F.concat_ws("|", "subset", "channel"))
    for group, name in ((None, "subset"), ("channel", "cell")):
        whole = T.fit(repeated, F.col("x"), group=name, trees=5, psi=32).cache()
        drawn = T.fit_subsets(d, feature_vector(COLS), subsets, group=group, trees=5, psi=32).cache()
        assert drawn.count() == whole.count() > 0
        assert drawn.select(whole.columns).exceptAll(whole).isEmpty()
    whole = T.fit(repeated, F.col("x"), group="subset", trees=5, psi=32)
    expected = T.score(repeated, whole, F.col("x"), "subset").select("segment", "subset", "score")
    drawn = T.fit_subsets(d, feature_vector(COLS), subsets, trees=5, psi=32)
    for block, part in ((2, 100), (8, 20_000)):
        scored = T.score_subsets(d, drawn, feature_vector(COLS), subsets, block=block, part=part)
        assert scored.count() == 1800 and scored.exceptAll(expected).isEmpty()
    none = T.score_subsets(d, T.fit_subsets(d.limit(3), feature_vector(COLS), subsets), feature_vector(COLS), subsets)
    assert none.count() == none.filter("score IS NULL").count() == 1800


def grown(width, trees=6, rows=64):
    """Trees over planted vectors as scoring holds them; the first feature has few values."""
    rng = np.random.default_rng(width)
    out = []
    for t in range(trees):
        x = rng.normal(size=(rows, width))
        x[:, 0] = np.round(x[:, 0] * 2)
        tree = T.grow(x, f"c#{t}#42", 6)
        out.append((*(np.array(tree[n]) for n in ("feature", "split", "left", "right", "length")), rows))
    return out


def test_scores_of_many_rows_are_those_of_one_row_walked_by_hand():
    """The table over bins, the single feature's cuts and the walk by blocks, with values on the cuts, missing and infinite ones."""
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 6):
        forest = grown(width)
        rows = rng.normal(size=(9000, width)) * 2
        rows[:2000, 0] = np.round(rows[:2000, 0])
        rows[2000], rows[2001], rows[2002] = np.nan, np.inf, -np.inf
        cuts = forest[0][1][forest[0][0] == 0]
        rows[3000:3000 + len(cuts), 0] = cuts
        got = T._descend(rows, forest)
        sizes = T._descend(rows, forest, [2, 6, 9])
        assert (sizes[:, 1] == got).all() and np.isnan(sizes[:, 2]).all()
        few = np.concatenate([T._descend(rows[i:i + 900], forest) for i in range(0, 9000, 900)])
        assert (few == got).all()
        for i in (0, 1, 1999, 2000, 2001, 2002, *range(3000, 3000 + len(cuts)), 8999):
            total = 0.0
            for n, (feature, split, left, right, length, _) in enumerate(forest, 1):
                at = 0
                while feature[at] >= 0:
                    at = left[at] if rows[i, feature[at]] <= split[at] else right[at]
                total += length[at]
                if n == 2:
                    assert sizes[i, 0] == np.power(2.0, -(total / 2) / T.average_path(64))
            assert got[i] == np.power(2.0, -(total / 6) / T.average_path(64))


def test_scores_of_subsets_in_place(spark):
    """By one broadcast or several, whole tasks or parts of them: the scores of a forest on repeated rows; a subset without a forest has none."""
    d = planted(spark)
    subsets = {"a": [0], "b+a": [1, 0], "none": [0, 1]}
    forest = T.grow_subsets(T.draws(d, feature_vector(COLS), trees=5, psi=32), subsets, 5).filter("grp <> 'none'").cache()
    want = {}
    for s, places in list(subsets.items())[:2]:
        columns = [COLS[i] for i in places]
        own = T.fit(d.withColumn("s", F.lit(s)), feature_vector(columns), group="s", trees=5, psi=32)
        want[s] = {r.segment: r.score for r in T.score(d.withColumn("s", F.lit(s)), own, feature_vector(columns), "s").collect()}
    for most, chunk in ((20_000, 65_536), (5, 70)):
        got = T.subset_scores(d, forest, feature_vector(COLS), subsets, ["segment"], 5, most, chunk).collect()
        assert len(got) == 600 and all(r.scores == [want["a"][r.segment], want["b+a"][r.segment], None] for r in got)


def test_forward_choice_against_forests_of_each_candidate(spark, monkeypatch):
    """Every step's pick, contamination and F1 from a forest per candidate; rows are drawn for the trees once for all steps."""
    cols = ["noise", "a", "b"]
    d = planted(spark).withColumn("noise", F.sin(F.col("segment") * 17.1)).withColumn("a", F.col("a") + F.cos(F.col("segment") * 1.7) * 4).withColumn("b", F.col("b") + F.sin(F.col("segment") * 2.3) * 4)
    fit, val = d.filter("segment % 5 < 2"), d.filter("segment % 5 > 2")
    drawn, samples = [], T._samples
    monkeypatch.setattr(T, "_samples", lambda *given: drawn.append(1) or samples(*given))
    got = [tuple(r) for r in X.forward_choice(fit, val, cols, steps=3, trees=12, psi=64).collect()]
    assert len(drawn) == 1
    monkeypatch.undo()

    def tried(c, chosen):
        v = feature_vector([*chosen, c])
        forest = T.fit(fit.withColumn("s", F.lit(c)), v, group="s", trees=12, psi=64)
        return [T.score(rows.withColumn("s", F.lit(c)), forest, v, "s").select("anomaly", "score").toPandas() for rows in (fit, val)]

    def area(held):
        pos, neg = ([s for y, s in zip(held.anomaly, held.score) if y == z] for z in (1, 0))
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))

    def f1(held, cut):
        hit = held.score > cut
        return 2 * (hit & (held.anomaly == 1)).sum() / (hit.sum() + held.anomaly.sum())

    want, chosen, best = [], [], 0.0
    while len(chosen) < 3:
        found = {c: tried(c, chosen) for c in cols if c not in chosen}
        top = min(found, key=lambda c: (-round(area(found[c][1]), 9), c))
        seen, held = found[top]
        if area(held) <= best + X.MIN_GAIN:
            break
        best, chosen = area(held), [*chosen, top]
        c = max(T.GRID, key=lambda c: (f1(held, np.quantile(seen.score, 1.0 - c)), -c))
        want.append((len(chosen), top, best, c, f1(held, np.quantile(seen.score, 1.0 - c))))
    assert len(want) > 1 and [g[:2] + g[3:4] for g in got] == [w[:2] + w[3:4] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 and abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, want))


def test_cuts_of_a_group_come_from_one_set_of_its_scores(spark):
    scores = spark.range(400).select(F.when(F.col("id") < 300, "A").otherwise("B").alias("channel"), F.abs(F.sin(F.col("id") * 1.3)).alias("score"))
    cuts = T.contamination_thresholds(scores, largest=300)
    assert cuts._jdf.queryExecution().optimizedPlan().toString().count("percentile(") == 1
    values = {c: [r.score for r in scores.filter(F.col("channel") == c).collect()] for c in "AB"}
    got = {(r.channel, r.c): r.threshold for r in cuts.collect()}
    assert len(got) == 20 and all(abs(t - np.quantile(values[g], 1.0 - c)) < 1e-12 for (g, c), t in got.items())
