import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import evidence as E
from tidemark.operators import rageval as Q
from tidemark.operators import retrieve as R
from tidemark.operators import selection as S
from tidemark.operators.encode import with_embeddings


def one(spark, column, *values):
    d = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in d.select(column(F.col("t"))).collect()]


def test_white_space(spark):
    got = one(spark, X.normalise_space, "north\xa0\nsouth", "two  \t spaces", "p\n\nq", None, "ﬁne", "p\n\n\n\n\nq \t")
    assert got == ["north\nsouth", "two spaces", "p\n\nq", "", "fine", "p\n\nq"]


def test_tokens(spark):
    a, b, c = one(spark, X.tokens, "rise_time >= 7.50 ms", "ZX9泵压偏低", "--lead a-b_c- _ 3.")
    assert a == ["rise_time", "7.50", "ms"] and b[0] == "zx9" and b[1:] == ["泵压", "压偏", "偏低"] and c == ["lead", "a-b_c", "3"]


def test_low_quality(spark):
    dots = "\n".join(f"{i} {'.' * 30} {i * 11}" for i in range(5))
    prose = "The pump was replaced on Tuesday after its pressure had fallen for three days in a row without any recovery."
    fixed = "returned due to non-completion of coordination."  # fixed value: a header scrap of the corpus
    assert one(spark, X.low_quality, "no", "\t", dots, fixed, prose, None) == [True] * 4 + [False, True]
    han = "泵" * 21
    assert one(spark, X.effective_length, han) == [42]
    assert one(spark, lambda c: X.low_quality(c, 42), han) == [False] and one(spark, lambda c: X.low_quality(c, 43), han) == [True]


def corpus(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, content string, source_name string, priority int")


def test_a_chunk_is_judged_once_for_all_its_queries(spark):
    """The verdict is made below the join with the pool, and a chunk row of each text has its own; rows without a key or a text stay as they were."""
    good, poor = " ".join(["the bearing of the pump is greased every forty hours"] * 3), "-- .. --"
    c = corpus(spark, [(1, good, "a", 1), (2, poor, "a", 1), (3, good, "b", 2), (3, poor, "b", 2), (4, None, "b", 2), (None, good, "b", 2)])
    pool = spark.createDataFrame([(q, i, 0.5, 1) for q in range(30) for i in (1, 2, 3, 4, None)], "query_id long, chunk_id long, score double, rank int")
    found = R.vector_pool(pool, c, 5)
    assert sorted((r.query_id, r.chunk_id, r.content) for r in found.collect()) == [(q, i, good) for q in range(30) for i in (1, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    judged = [n for n, line in enumerate(plan) if "Generate explode(array(" in line]
    assert len(judged) == 1 and judged[0] > next(n for n, line in enumerate(plan) if "Join Inner" in line)
    assert not [line for line in plan if "Filter" in line and "regexp_replace" in line]
    assert "_low" not in found.columns and "_asked" not in found.columns
    merged = R.hybrid_merge(pool.filter("chunk_id = 2").drop("rank"), pool.filter("chunk_id IN (2, 3)").drop("rank"), c)
    assert sorted((r.query_id, r.chunk_id, r.content) for r in merged.collect()) == [(q, i, t) for q in range(30) for i, t in ((2, poor), (3, good))]


def test_judged_alike_without_broadcasts(spark, monkeypatch):
    c = corpus(spark, [(i, TEXTS[i % 2] if i % 3 else "...", "a", 1) for i in range(12)])
    pool = spark.createDataFrame([(q, i, 0.5, 1) for q in range(4) for i in range(q, 12)], "query_id long, chunk_id long, score double, rank int")
    rows = []
    for most in (R.MAX_BROADCAST_POOL, 2):
        monkeypatch.setattr(R, "MAX_BROADCAST_POOL", most)
        rows.append(sorted((r.query_id, r.chunk_id) for r in R.vector_pool(pool, c, 5).collect()))
    assert rows[0] == rows[1] == [(q, i) for q in range(4) for i in range(q, 12) if i % 3]


def test_little_is_held_before_the_best_are_known(monkeypatch):
    """Slices of few chunks let through nearly all scores; no more than a few times the best n is held, and the best are the same."""
    import pyarrow as pa
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    docs = [sorted(set(rng.choice(words, 8).tolist())) for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([len(t) for t in docs], pa.int64()), pa.array(docs), pa.array([[1 + n % 3 for n, _ in enumerate(t)] for t in docs], pa.list_(pa.int32()))],
                                       names=["chunk_id", "doc_len", "tokens", "tfs"])
    names, weights = R._by_token(*map(list, zip(*[(q, w, 0.1 + words.index(w) / 7) for q in range(50) for w in rng.choice(words, 6, replace=False).tolist()])))
    sizes, real, rows = [], np.lexsort, []
    monkeypatch.setattr(R.np, "lexsort", lambda keys, *a: (sizes.append(len(keys[0])), real(keys, *a))[1])
    for cells, looked_up in ((400, 2500), (400, 37), (10**6, 2500)):
        monkeypatch.setattr(R, "CELLS", cells)
        monkeypatch.setattr(R, "LOOKED_UP", looked_up)
        sizes.clear()
        rows.append([tuple(r.values()) for b in R._best_chunks(iter([batch]), weights, names, 7.0, 5, 1.5, 0.75) for r in b.to_pylist()])
        assert max(sizes) <= max(7 * 5, 4 * 5 + 8) * 50
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 250


def test_tokens_need_no_white_space_settled(spark):
    """Tokens of a text as it is are those of the normalised text."""
    texts = ["a\u3000b \u00a0 c\n\n\n\n d", "  ﬁne-ﬂow \t x_1 \n 3 . 5 3.5", "泵轴 \n 泵\u2003轴承", "\x1c\x85", "", None, "İx Ⅷ 9\u205f8"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = d.select("i", X.tokens(F.col("t")).alias("a"), X.tokens(X.normalise_space(F.col("t"))).alias("b")).orderBy("i").collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    plan = d.select(X.tokens(F.col("t")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_diverse_makes_its_pool_once(spark):
    from tidemark.operators.selection import select_diverse
    pool = spark.createDataFrame([(q, i, 1.0 - i / 50, None if i == 7 else f"s{i % (q + 1)}") for q in range(3) for i in range(9)] + [(None, 1, 0.3, "s")],
                                 "query_id long, chunk_id long, score double, source_name string")
    got = {}
    for r in select_diverse(pool, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r["rank"]))
    assert got == {0: [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)], 1: [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)], 2: [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]}
    plan = select_diverse(pool, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


TEXTS = ["bearings of the feed pump are greased every forty hours and their play is written down by the crew on shift",
         "valve lift and valve seat wear decide how long the compressor can run before its next overhaul in the workshop"]


def test_bm25_order_and_boost(spark):
    c = corpus(spark, [(0, TEXTS[0], "a", 1), (1, TEXTS[1], "b", 1)])
    q = spark.createDataFrame([(1, "bearings"), (2, "valve seat VALVE"), (3, "qqqq")], "query_id long, text string")
    scored = R.bm25(c, q)
    assert R.top_n(scored.filter("query_id = 1"), 1).first().chunk_id == 0
    once = {(r.query_id, r.chunk_id): r.score for r in scored.collect()}
    twice = {(r.query_id, r.chunk_id): r.score for r in R.bm25(c, q, distinct=False).collect()}
    assert twice[(2, 1)] > once[(2, 1)]
    vec = spark.createDataFrame([(2, 1, 0.7), (3, 1, 0.3)], "query_id long, chunk_id long, score double")
    merged = {(r.query_id, r.chunk_id): r for r in R.hybrid_merge(vec, scored, c).collect()}
    assert merged[(2, 1)].score == pytest.approx(0.72) and merged[(3, 1)].score == 0.3
    assert (1, 0) not in merged  # no vector candidate, no keyword rows
    only = spark.createDataFrame([(1, 1, 0.7)], "query_id long, chunk_id long, score double")
    row = {r.chunk_id: r for r in R.hybrid_merge(only, scored, c).collect()}[0]
    assert row.keyword_only and row.score == pytest.approx(0.04)
    assert {r.chunk_id: r.score for r in R.hybrid_merge(only, scored, c, keyword_only_factor=1.0).collect()}[0] == pytest.approx(0.02)


def test_keyword_top_equals_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    c = corpus(spark, [(i, " ".join(rng.choice(words, rng.integers(0, 25))), "a", 1) for i in range(150)]).repartition(5)
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(1, 6)))) for i in range(12)] + [(90, "none"), (91, "")], "query_id long, text string")
    scored = R.bm25(c, q)
    want = sorted(tuple(r) for r in R.top_n(scored, 4).select("query_id", "rank", "chunk_id", "score").collect())
    terms = R.chunk_terms(c)
    for block in (200_000, 3):
        monkeypatch.setattr(R, "TERM_BLOCK", block)
        monkeypatch.setattr(R, "PART_CHUNKS", 60)
        got = sorted(tuple(r) for r in R.keyword_top(terms, q, 4).select("query_id", "rank", "chunk_id", "score").collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    pairs = spark.createDataFrame([(0, 3), (1, 7), (1, 7), (90, 1)] + [(i, i) for i in range(12)], "query_id long, chunk_id long")
    known = {(r.query_id, r.chunk_id): r.score for r in scored.collect()}
    some = {(r.query_id, r.chunk_id): r.score for r in R.keyword_scores_of(pairs, terms, q).collect()}
    assert some == pytest.approx({k: v for k, v in known.items() if k in {(r.query_id, r.chunk_id) for r in pairs.collect()}})


def test_salted_term_join_is_the_same(spark, monkeypatch):
    c = corpus(spark, [(i, f"the pump number {i} and word{i % 3}", "a", 1) for i in range(30)])
    q = spark.createDataFrame([(1, "the pump word1"), (2, "word2 number")], "query_id long, text string")
    want = sorted(R.bm25(c, q).collect())
    monkeypatch.setattr(R, "MAX_BROADCAST_TERMS", 1)
    assert sorted(R.bm25(c, q).collect()) == want


def test_vector_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m, q = rng.normal(size=(200, 8)), rng.normal(size=(5, 8))
    m[50] = m[10]
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "chunk_id long, embedding array<double>").repartition(7)
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    got = {(r.query_id, r["rank"]): r.chunk_id for r in R.vector_top_k(c, qs, 6).collect()}
    sims = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (m / np.linalg.norm(m, axis=1)[:, None]).T, 9)
    for i in range(5):
        assert [got[(i, r)] for r in range(1, 7)] == list(np.lexsort((np.arange(200), -sims[i]))[:6])
    exact = R.vector_top_k(c, qs, 6)
    salted = R.approximate_top_k(c, qs, 6, n_cells=4, n_probe=4, rows_per_task=9)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, exact.collect()))
    few = R.approximate_top_k(c, qs, 6, n_cells=4, n_probe=1)
    assert few.count() <= 30 and few.join(exact, ["query_id", "chunk_id"]).count() > 0
    assert R.recall_at_k(R.approximate_top_k(c, qs, 6, n_cells=4, n_probe=4), exact).agg(F.min("recall")).first()[0] == 1.0


def pool(spark, rows):
    return spark.createDataFrame([(1, i, float(s), src, p) for i, (s, src, p) in enumerate(rows)],
                                 "query_id long, chunk_id long, score double, source_name string, priority int")


def picked(spark, rows, k):
    return S.select_candidates(pool(spark, rows), k).orderBy("rank").collect()


def test_seats_go_by_priority_inside_the_zone_only(spark):
    plain = [(0.71 - 0.002 * i, "manual", 4) for i in range(9)]
    got = picked(spark, plain + [(0.64, "log", 2)], 4)
    assert [r.source_name for r in got].count("log") == 1 and [r.reserved for r in got if r.source_name == "log"] == [True]
    got = picked(spark, plain + [(0.71 - S.REL_DELTA - 0.05, "log", 2)], 4)
    assert {r.source_name for r in got} == {"manual"} and not any(r.reserved for r in got)


def test_caps_hold_while_other_sources_can_fill(spark):
    for priority, cap in S.CAPS.items():
        rows = [(0.8 - 0.001 * i, "one", priority) for i in range(6)] + [(0.77 - 0.001 * i, f"other{i}", 5) for i in range(6)]
        got = picked(spark, rows, 6)
        assert [r.source_name for r in got].count("one") == cap and len(got) == 6


def test_ties_go_to_the_smaller_chunk(spark):
    got = picked(spark, [(0.5, f"s{i}", 5) for i in range(7)], 3)
    assert [r.chunk_id for r in got] == [0, 1, 2]


def select_by_loop(rows, k, delta=0.12):
    """Plain statement of the policy for the random check."""
    top = max(s for s, _, _ in rows)
    zone = [i for i, (s, _, _) in enumerate(rows) if s >= top - delta]
    order = lambda ids: sorted(ids, key=lambda i: (-rows[i][0], i))
    sources = {}
    for i in zone:
        sources.setdefault(rows[i][1], []).append(i)
    ranked = sorted(sources.values(), key=lambda ids: (min(rows[i][2] for i in ids), -max(rows[i][0] for i in ids)))
    chosen = [order(ids)[0] for ids in ranked if min(rows[i][2] for i in ids) <= 2][:max(1, k // 2)]
    outside = [i for i in range(len(rows)) if i not in zone]
    for ids, capped in ((zone, True), (zone, False), (outside, True), (outside, False)):
        for i in order(ids):
            used = sum(rows[j][1] == rows[i][1] for j in chosen)
            if len(chosen) < k and i not in chosen and (not capped or used < S.CAPS.get(rows[i][2], 1)):
                chosen.append(i)
    return order(chosen[:k])


def test_selection_matches_plain_policy(spark):
    rng = np.random.default_rng(5)
    cases = []
    for c in range(40):
        n = int(rng.integers(3, 25))
        scores = sorted(rng.choice(np.arange(400, 700), size=n, replace=False) / 1000.0, reverse=True)
        cases.append([(float(s), f"s{rng.integers(0, 5)}", int(rng.integers(0, 7))) for s in scores])
    rows = [(c, i, s, src, p) for c, case in enumerate(cases) for i, (s, src, p) in enumerate(case)]
    d = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, source_name string, priority int")
    got = {}
    for r in S.select_candidates(d, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for c, case in enumerate(cases):
        assert got[c] == select_by_loop(case, 5), c


def test_context_stops_at_first_overflow(spark):
    rows = [(1, 1, "a" * 40, 0.9, False), (1, 2, "b" * 4000, 0.8, False), (1, 3, "c" * 40, 0.7, False), (2, 1, "d" * 40, 0.3, True)]
    d = spark.createDataFrame(rows, "query_id long, rank int, content string, score double, low_confidence boolean")
    got = {r.query_id: r for r in E.pack_context(d, budget=200).collect()}
    assert got[1].pieces == 1 and got[1].context == "a" * 40 + "\n【来源：未知来源 第 未知页码 页】"
    assert got[2].context.startswith("【检索置信度低】最佳片段相似度仅 0.3000，低于 0.45") and got[2].pieces == 1


def test_sections_json_and_headings(spark):
    text = "intro\n**【可能原因】**\n1. a\n\n# x\n2. b\n**结论**：\nfine\n**【可能原因】**\nlater\n- **建议** not a heading here\n**【来源】**\n"
    d = spark.createDataFrame([(1, text), (2, '{"结论": "ok", "n": 1}'), (3, "nothing"), (4, None)], "id int, answer string")
    got = {(r.id, r.section): r.body for r in E.parse_sections(d, "id").collect()}
    assert got == {(1, "可能原因"): "later\n- **建议** not a heading here", (1, "结论"): "fine", (2, "结论"): "ok", (2, "n"): "1"}


def test_failed_answers(spark):
    bad = ["RAG解释生成失败：x", "检索失败", "x 生成失败", "RAG 查询失败", "查询过程中出现错误", "RAG引擎初始化失败", "�" * 50]
    ok = ["磁力计噪声，建议复查。", "plain text", ""]
    assert one(spark, E.garbled, *bad, *ok) == [True] * 7 + [False] * 3
    assert one(spark, E.garbled_strict, *bad, *ok) == [True] * 7 + [False] * 3


def test_general_number_format(spark):
    values = [0.00001234567, 123456.0, 0.25, 28.218855, 1e-4, 0.0, 99999.9, -3.0]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in d.select(E.general_format(F.col("v"))).collect()] == [f"{v:.4g}" for v in values]


def test_judged_queries_and_regressions(spark):
    res = spark.createDataFrame([(1, 1, "x", "has Alpha", 0.9), (1, 2, "y", "none", 0.8), (2, 1, "z", "beta", 0.7)],
                                "query_id long, rank int, source_name string, content string, score double")
    specs = spark.createDataFrame([(1, "k", ["x"], ["alpha", "gamma"]), (2, "k", ["x"], ["beta"]), (3, "m", ["x"], ["q"])],
                                  "query_id long, kind string, expect_sources array<string>, must_terms array<string>")
    j = Q.judge_queries(res, specs)
    got = {r.query_id: r for r in j.collect()}
    assert got[1].rank_first_usable == 1 and got[1].kw_recall == 0.5 and not got[2].usable_at_k and got[3].top1_source == "<empty>"
    total = Q.summarise_queries(j).filter("kind IS NULL").first()
    assert total.n == 3 and total.mrr == 1.0
    worse = j.withColumn("rank_first_usable", F.when(F.col("query_id") == 1, 3))
    flags = {r.query_id: r.regression for r in Q.compare_runs(j, worse).collect()}
    assert flags == {1: True, 2: False, 3: False}
    assert not any(r.regression for r in Q.compare_runs(worse, j).collect())


def test_encoder_plug_in(spark):
    d = corpus(spark, [(0, "aab", "s", 1), (1, "", "s", 1)])
    got = with_embeddings(d, lambda texts: np.array([[t.count("a"), t.count("b")] for t in texts])).orderBy("chunk_id").collect()
    assert got[0].embedding == pytest.approx([2 / 5 ** 0.5, 1 / 5 ** 0.5]) and got[1].embedding == [0.0, 0.0]


def test_raw_sections_keep_their_headings(spark):
    from tidemark.operators.evidence import raw_sections
    text = "before\n\n**1. 异常通道分析**\nx\n**异常类型与可能原因**：\n- y\n【建议】\nfirst\n**建议措施**\n second \n**其他**\n"
    d = spark.createDataFrame([(1, text), (2, "no heading"), (3, ""), (4, None), (5, "**总结**"), (6, "")], "id long, answer string")
    got = {(r.id, r.section): (r.body, r.metric) for r in raw_sections(d, "id").collect()}
    assert got == {
        (1, "_header"): ("before", "before"), (1, "通道定位"): ("**1. 异常通道分析**\nx", "x"), (1, "异常类型"): ("", ""),
        (1, "可能原因"): ("**异常类型与可能原因**：\n- y", "- y"), (1, "建议措施"): ("**建议措施**\n second \n**其他**", "second"), (5, "结论"): ("**总结**", "")}


def test_many_queries_are_scored_in_bounded_slices(monkeypatch):
    """20,000 queries against a batch of 300 chunks: never more than CELLS scores at once, same result."""
    import numpy as np
    import pyarrow as pa
    from tidemark.operators import retrieve as R
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    tokens = [list(dict.fromkeys(rng.choice(words, 12).tolist())) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([len(t) for t in tokens], pa.int64()), pa.array(tokens), pa.array([[1] * len(t) for t in tokens], pa.list_(pa.int32()))],
                                       names=["chunk_id", "doc_len", "tokens", "tfs"])
    asked = [(q, w, float(1 + q % 3)) for q in range(20_000) for w in rng.choice(words, 2, replace=False).tolist()]
    names, weights = R._by_token(*map(list, zip(*asked)))
    sizes, real = [], np.zeros

    def zeros(shape, *a):
        sizes.append(shape)
        return real(shape, *a)
    results = []
    for cells in (200_000, 10**9):
        monkeypatch.setattr(R, "CELLS", cells)
        monkeypatch.setattr(R.np, "zeros", zeros)
        sizes.clear()
        results.append(sorted(tuple(r.values()) for b in R._best_chunks(iter([batch]), weights, names, 11.5, 2, 1.2, 0.75) for r in b.to_pylist()))
        assert max(a * b for a, b in sizes) <= max(cells, 20_000)
    assert results[0] == results[1] and len(results[0]) > 20_000


def test_best_of_slices_equals_a_full_sort():
    """Ties, missing ids and missing scores; slices of any size give the same rows, by ids in order with missing ones first."""
    rng = np.random.default_rng(5)
    ids = np.array([None, *range(299)], dtype=object)
    scores = np.round(rng.random((7, 300)), 1)
    scores[3, :295] = np.nan
    want = [(q, ids[i], scores[q, i]) for q in range(7) for i in sorted(range(300), key=lambda i: (-np.nan_to_num(scores[q, i], nan=-1.0), i))[:6]]
    for step in (1, 13, 300):
        best = R._Best(7, 6)
        for at in range(0, 300, step):
            best.add(ids[at:at + step], scores[:, at:at + step])
        got = [tuple(r.values()) for b in best.rows(list(range(7))) for r in b.to_pylist()]
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], nan_ok=True)


def test_scores_of_repeated_chunks_add_up_in_bounded_slices():
    """A chunk that has a token by two lengths gets both parts; no slice is larger than the cells allow."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3]), pa.array([[4, 9, 4], [5], []], pa.list_(pa.int64())), pa.array([["x", "x", "y"], ["z"], []], pa.list_(pa.string())),
                                        pa.array([[1, 2, 1], [1], []], pa.list_(pa.int64()))], names=["chunk_id", "doc_len", "tokens", "tfs"])
    names, weights = R._by_token([7, 7, 8], ["x", "y", "x"], [1.0, 2.0, 0.5])

    def part(tf, n):
        return tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 5.0))
    for cells in (2, 100):
        slices = list(R._totals(iter([batch]), weights, 2, 5.0, 1.5, 0.75, cells))
        assert max(t.size for _, t in slices) <= max(cells, 2)
        totals = np.concatenate([t for _, t in slices])
        x = part(1, 4) + part(2, 9)
        assert totals == pytest.approx(np.array([[x + 2 * part(1, 4), x / 2], [0, 0], [0, 0]]))


def test_bm25_shuffles_no_scores(spark):
    c = corpus(spark, [(i, f"the pump number {i} and word{i % 3}", "a", 1) for i in range(30)])
    plan = R.bm25(c, spark.createDataFrame([(1, "the pump word1")], "query_id long, text string"))._jdf.queryExecution().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "query_id" in line]


def test_best_chunks_of_query_blocks_equal_all_scores(monkeypatch):
    """Common tokens by matrix, others pair by pair, chunks that are alike: the best of the exact scores, whatever the blocks and slices; no more is held than the best."""
    import pyarrow as pa
    rng = np.random.default_rng(2)
    words, share = [f"w{i}" for i in range(300)], 1.0 / np.arange(1, 301)
    docs = [sorted(set(rng.choice(words, 25, p=share / share.sum()).tolist())) for _ in range(260)]
    docs[200:230] = docs[:30]
    tfs = [[1 + len(t) * i % 3 for i, _ in enumerate(t)] for t in docs]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(at, at + 130)), pa.array([sum(t) for t in tfs[at:at + 130]], pa.int64()), pa.array(docs[at:at + 130], pa.list_(pa.string())),
                                           pa.array(tfs[at:at + 130], pa.list_(pa.int32()))], names=["chunk_id", "doc_len", "tokens", "tfs"]) for at in (0, 130)]
    asked = [(q, w, 0.3 + len(w) * 0.17 + words.index(w) / 90) for q in range(40) for w in rng.choice(words, 9, replace=False, p=share / share.sum()).tolist()]
    names, weights = R._by_token(*map(list, zip(*asked)))
    totals = np.round(np.concatenate([t for _, t in R._totals(iter(batches), weights, len(names), 40.0, 1.5, 0.75, 10**6)]), 9)
    want = [(q, int(i)) for j, q in enumerate(names) for i in np.lexsort((np.arange(260), -totals[:, j]))[:5] if totals[i, j] > 0]
    held, real = [], R._Best.take
    monkeypatch.setattr(R._Best, "take", lambda self, *a: (real(self, *a), held.append(self.queries)))
    for block, cells, common in ((7, 700, 1024), (4096, 4_000_000, 1024), (40, 4000, 0), (40, 10**6, 3)):
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        monkeypatch.setattr(R, "CELLS", cells)
        monkeypatch.setattr(R, "COMMON", common)
        got = [r for b in R._best_chunks(iter(batches), weights, names, 40.0, 5, 1.5, 0.75) for r in b.to_pylist()]
        assert [(r["query_id"], r["chunk_id"]) for r in got] == want
        assert [r["score"] for r in got] == pytest.approx([totals[i, names.index(q)] for q, i in want])
        assert max(held) <= block
        held.clear()
