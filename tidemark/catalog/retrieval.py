"""Text, retrieval and answer queries over documents, benchmark, embeddings, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.catalog import Entry
from tidemark.catalog import inputs as I
from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.operators import chunking as C
from tidemark.operators import evidence as E
from tidemark.operators import rageval as Q
from tidemark.operators import retrieve as R
from tidemark.operators import selection as S


def rounded(df, *cols, places=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


# ---- inputs

def chunks(spark, sf):
    return I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("source_name"),
        (F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 6).alias("priority"), F.col("lang").alias("language"))


def keyword_queries(spark, sf):
    return I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark, sf):
    """Postings and statistics, built once per application like a stored index."""
    posted = I.stored(spark, sf, "postings", lambda: R.postings(chunks(spark, sf)))
    return posted, I.stored(spark, sf, "index_statistics", lambda: R.index_statistics(chunks(spark, sf), posted=posted))


def keyword_scores(spark, sf):
    posted, stats = index(spark, sf)
    return R.bm25(chunks(spark, sf), keyword_queries(spark, sf), posted=posted, stats=stats)


def term_index(spark, sf):
    """The index by chunk, built once per application."""
    return I.stored(spark, sf, "chunk_terms", lambda: R.chunk_terms(chunks(spark, sf)))


def label_vectors(spark, sf):
    """The mean vector of each label."""
    e = I.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("long").alias("label")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def label_queries(spark, sf):
    """One query per benchmark text; its vector is the mean of a label, dealt out by number."""
    means = label_vectors(spark, sf)
    placed = means.withColumn("_at", F.row_number().over(W.orderBy("label")) - 1)  # one row per label
    return keyword_queries(spark, sf).crossJoin(means.agg(F.count(F.lit(1)).alias("_n"))).withColumn("_at", F.pmod("query_id", F.col("_n"))).join(
        placed.select("_at", "embedding"), "_at").select("query_id", "embedding", "text")


def vectors(spark, sf):
    return I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


CHUNKS_SQL = "chunks AS (SELECT doc_id AS chunk_id, text AS content, source AS source_name, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 6 AS priority, lang AS language FROM documents)"
QUERIES_SQL = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"


def quote(s):
    return "'" + s.replace("'", "''") + "'"


def norm_sql(c):
    out = f"coalesce({c}, '')"
    for a, b in X.LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace({out}, {quote(X.INLINE_SPACE + '+')}, ' ', 'g')"
    out = f"regexp_replace({out}, ' *\n *', '\n', 'g')"
    out = f"regexp_replace({out}, '\n\n\n+', '\n\n', 'g')"
    return f"regexp_replace({out}, '\\A[ \n]+|[ \n]+\\z', '', 'g')"


def strip_sql(c):
    return f"regexp_replace(coalesce({c}, ''), {quote(chr(92) + 'A' + X.ANY_SPACE + '+|' + X.ANY_SPACE + '+' + chr(92) + 'z')}, '', 'g')"


def tokens_sql(c):
    low = f"lower({norm_sql(c)})"
    words = f"list_filter(list_transform(regexp_extract_all({low}, '[a-z][a-z0-9_\\-]*|\\p{{Nd}}+(?:\\.\\p{{Nd}}+)?'), lambda w: regexp_replace(w, '^[-_]+|[-_]+$', '', 'g')), lambda w: w <> '')"
    runs = f"regexp_extract_all({low}, {quote(X.CJK + '{2,}')})"
    return f"list_concat({words}, flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))))"


def low_sql(c):
    bare = strip_sql(c)
    punct = quote(X.PUNCTUATION)
    return f"""(SELECT length(b) = 0 OR length(b) + length(b) - length(regexp_replace(b, {quote(X.CJK)}, '', 'g')) < 80
 OR (CASE WHEN length(b) = 0 THEN 1.0 ELSE (length(b) - length(translate(b, {punct}, ''))) / length(b) END) > 0.55 OR contains(lower(b), 'returned due to non-completion') FROM (SELECT {bare} AS b))"""


BM25_SQL = f"""{CHUNKS_SQL}, {QUERIES_SQL}, toks AS (SELECT chunk_id, {tokens_sql('content')} AS t FROM chunks),
lens AS (SELECT chunk_id, len(t) AS doc_len FROM toks), post AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS token FROM toks) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM lens), dfs AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT DISTINCT query_id, unnest({tokens_sql('text')}) AS token FROM queries),
kw AS (SELECT query_id, chunk_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1.0 - 0.75 + 0.75 * doc_len / avgdl))), 9) AS score
 FROM qt JOIN post USING (token) JOIN dfs USING (token) JOIN lens USING (chunk_id), st GROUP BY 1, 2)"""


def top_sql(source, n, out):
    return f"{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {n})"


VEC_SQL = """lq AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS e FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM
 (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
labq AS (SELECT item_id AS query_id, e, text FROM benchmark JOIN (SELECT e, row_number() OVER (ORDER BY query_id) - 1 AS place, count(*) OVER () AS n FROM lq) ON place = item_id % n),
sims AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 9) AS score FROM labq, embeddings)"""


# ---- text

def normalised(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", X.normalise_space(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


def token_stats(spark, sf):
    d = I.table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def index_table(spark, sf):
    p, stats = index(spark, sf)
    d = p.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return rounded(d.join(F.broadcast(stats)).select("token", "df", "cf", R.idf(F.col("n_chunks"), F.col("df")).alias("idf"), "avg_len"), "idf", "avg_len")


def bm25(spark, sf):
    """Scores of every query and chunk that share a token."""
    return rounded(keyword_scores(spark, sf), "score")


def bm25_without_index(spark, sf):
    """The same scores straight from the texts."""
    return rounded(R.bm25(chunks(spark, sf), keyword_queries(spark, sf)), "score")


def bm25_top(spark, sf):
    return rounded(R.keyword_top(term_index(spark, sf), keyword_queries(spark, sf), 40), "score").withColumn("rank", F.col("rank").cast("long"))


def quality(spark, sf):
    t = F.col("content")
    return chunks(spark, sf).select("chunk_id", X.effective_length(X.strip(t)).cast("long").alias("length"),
                                    F.round(X.junk_ratio(X.strip(t)), 6).alias("junk"), X.low_quality(t).alias("low"))


def quality_counts(spark, sf):
    low = X.low_quality(F.col("content"))
    return chunks(spark, sf).agg(F.count_if(~low).alias("kept"), F.count_if(low).alias("dropped"))


def quality_labels(spark, sf):
    """Quality verdict against the given labels."""
    from tidemark.operators.evaluate import evaluate

    d = chunks(spark, sf).join(I.table(spark, sf, "labels").withColumnRenamed("doc_id", "chunk_id"), "chunk_id")
    d = d.select(F.col("quality").alias("anomaly"), (~X.low_quality(F.col("content"))).cast("int").alias("pred"))
    return evaluate(d).select("tn", "fp", "fn", "tp", F.round("f1", 6).alias("f1"))


def page_text(spark, sf):
    d = I.table(spark, sf, "pages").select("page_id", X.strip_tags(F.col("html")).alias("t"))
    return d.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


PAGE_SQL = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    PAGE_SQL = f"replace({PAGE_SQL}, '{_a}', '{_b}')"


def chunk_table(spark, sf):
    return C.chunk_documents(I.table(spark, sf, "documents")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("chunk_size").alias("longest"), F.sum("chunk_size").alias("chars"))


# ---- vectors

def unit_vectors(spark, sf):
    d = vectors(spark, sf).select("chunk_id", V.unit(F.col("embedding")).alias("u"))
    return d.select("chunk_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(V.norm(F.col("u")), 6).alias("norm"))


def pair_similarities(spark, sf):
    d = vectors(spark, sf).join(label_vectors(spark, sf).withColumnRenamed("embedding", "q").withColumn("label", F.col("label").cast("int")), "label")
    a, b = F.col("embedding"), F.col("q")
    return d.select("chunk_id", F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.dot(a, b), 6).alias("inner"), F.round(V.distance(a, b), 6).alias("l2"))


def nearest(spark, sf, k=10):
    return R.vector_top_k(vectors(spark, sf), label_queries(spark, sf), k)


def top_k(spark, sf):
    return rounded(nearest(spark, sf), "score").withColumn("rank", F.col("rank").cast("long"))


def top_k_l2(spark, sf):
    d = R.vector_top_k(vectors(spark, sf), label_queries(spark, sf), 10, "l2")
    return rounded(d, "score", places=5).withColumn("rank", F.col("rank").cast("long"))


def approximate(spark, sf):
    v, q = vectors(spark, sf), label_queries(spark, sf)
    return R.recall_at_k(R.approximate_top_k(v, q, 10, n_cells=12, n_probe=4), R.vector_top_k(v, q, 10))


# ---- fusion

def pools(spark, sf):
    def build_v():
        return R.vector_pool(nearest(spark, sf, R.pool_depth(5)), chunks(spark, sf), 5, threshold=0.1)

    return I.stored(spark, sf, "vector_pool", build_v), I.stored(
        spark, sf, "keyword_pool", lambda: R.keyword_top(term_index(spark, sf), label_queries(spark, sf), R.KEYWORD_POOL).drop("rank"))


VPOOL_SQL = f"""{VEC_SQL}, {top_sql('sims', 40, 'deep')}, vpool AS (SELECT query_id, chunk_id, score, content, source_name, priority FROM deep JOIN chunks USING (chunk_id) WHERE score >= 0.1 AND NOT {low_sql('content')})"""
HYBRID_SQL = f"""{BM25_SQL}, {VPOOL_SQL}, {top_sql('kw', 40, 'ktop')}, kn AS (SELECT query_id, chunk_id, score AS keyword_match, score / max(score) OVER (PARTITION BY query_id) AS s FROM ktop WHERE query_id IN (SELECT query_id FROM vpool)),
merged AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, keyword_match, v.chunk_id IS NULL AS keyword_only,
 CASE WHEN v.chunk_id IS NULL THEN 0.02 * coalesce(s, 0.0) * 2.0 ELSE v.score + 0.02 * coalesce(s, 0.0) END AS score FROM vpool v FULL JOIN kn k ON k.query_id = v.query_id AND k.chunk_id = v.chunk_id),
hyb AS (SELECT m.*, source_name, priority, content FROM merged m JOIN chunks USING (chunk_id) WHERE NOT keyword_only OR NOT {low_sql('content')})"""


def vpool(spark, sf):
    return rounded(pools(spark, sf)[0].select("query_id", "chunk_id", "score"), "score")


def hybrid_pool(spark, sf):
    v, k = pools(spark, sf)
    return R.hybrid_merge(v, k, chunks(spark, sf))


def hybrid(spark, sf):
    return rounded(hybrid_pool(spark, sf).select("query_id", "chunk_id", "keyword_only", "score", "keyword_match"), "score", "keyword_match")


def rrf(spark, sf):
    v, k = pools(spark, sf)
    k = R.top_n(k, 40).join(v.select("query_id").distinct(), "query_id", "left_semi")
    return rounded(R.reciprocal_rank_fusion(v, k), "score", places=8)


RRF_SQL = f"""{BM25_SQL}, {VPOOL_SQL}, {top_sql('kw', 40, 'ktop')}, a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM vpool),
b AS (SELECT query_id, chunk_id, rank AS r FROM ktop WHERE query_id IN (SELECT query_id FROM vpool))
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, round(coalesce(1.0 / (60 + a.r), 0.0) + coalesce(1.0 / (60 + b.r), 0.0), 8)::DOUBLE AS score
FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id"""


def blends(spark, sf):
    v, k = pools(spark, sf)
    k = R.top_n(k, 40).drop("rank").join(v.select("query_id").distinct(), "query_id", "left_semi")
    out = None
    for mode, alpha in (("linear", 0.3), ("additive", 0.1), ("decay", 0.05)):
        d = R.blend(v, k, mode, alpha, chunks(spark, sf)).withColumn("mode", F.lit(mode))
        out = d if out is None else out.unionByName(d)
    return rounded(out, "score")


BLEND_SQL = f"""WITH {BM25_SQL}, {VPOOL_SQL}, {top_sql('kw', 40, 'ktop')}, k AS (SELECT * FROM ktop WHERE query_id IN (SELECT query_id FROM vpool)),
p AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.score AS vs, coalesce(v.score, 0.0) AS v, k.score AS k, k.rank FROM vpool v FULL JOIN k ON k.query_id = v.query_id AND k.chunk_id = v.chunk_id),
ps AS (SELECT *, coalesce(k / max(k) OVER (PARTITION BY query_id), 0.0) AS s FROM p), pq AS (SELECT ps.* FROM ps JOIN chunks USING (chunk_id) WHERE vs IS NOT NULL OR NOT {low_sql('content')}),
z AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM pq WINDOW w AS (PARTITION BY query_id))
SELECT 'linear' AS mode, query_id, chunk_id, round(0.7 * (v - lo) / (hi - lo) + 0.3 * s, 6)::DOUBLE AS score FROM z UNION ALL SELECT 'additive', query_id, chunk_id, round(v + 0.1 * s, 6)::DOUBLE FROM z
UNION ALL SELECT 'decay', query_id, chunk_id, round(v + coalesce(0.05 / rank, 0.0), 6)::DOUBLE FROM z"""


def reranked(spark, sf):
    """The keyword score stands in for a second scorer."""
    v, _ = pools(spark, sf)
    second = R.keyword_scores_of(v, term_index(spark, sf), label_queries(spark, sf)).select("query_id", "chunk_id", F.col("score").alias("score2"))
    pool = v.join(second.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    out = None
    for mode in ("all", "head", "blend", "bonus"):
        d = R.rerank(pool, second, mode, head=5).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), F.lit(mode).alias("mode"))
        out = d if out is None else out.unionByName(d)
    return rounded(out, "score")


RERANK_SQL = f"""WITH {BM25_SQL}, {VPOOL_SQL}, p AS (SELECT query_id, chunk_id, v.score AS v, k.score AS k, row_number() OVER (PARTITION BY query_id ORDER BY v.score DESC, chunk_id) AS r FROM vpool v JOIN kw k USING (query_id, chunk_id)),
n AS (SELECT *, coalesce((v - min(v) OVER w) / (CASE WHEN max(v) OVER w > min(v) OVER w THEN max(v) OVER w - min(v) OVER w ELSE 1.0 END), 0.0) AS vn, coalesce((k - min(k) OVER w) / (CASE WHEN max(k) OVER w > min(k) OVER w THEN max(k) OVER w - min(k) OVER w ELSE 1.0 END), 0.0) AS kn FROM p WINDOW w AS (PARTITION BY query_id)),
u AS (SELECT 'all' AS mode, query_id, chunk_id, k AS score, 0 AS g, 0 AS r FROM n UNION ALL SELECT 'head', query_id, chunk_id, CASE WHEN r <= 5 THEN k ELSE v END, CAST(r > 5 AS INTEGER), CASE WHEN r <= 5 THEN 0 ELSE r END FROM n
 UNION ALL SELECT 'blend', query_id, chunk_id, 0.7 * vn + 0.3 * kn, 0, 0 FROM n UNION ALL SELECT 'bonus', query_id, chunk_id, v + 0.02 * kn, 0, 0 FROM n)
SELECT mode, query_id, chunk_id, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY mode, query_id ORDER BY g, r, score DESC, chunk_id) AS rank FROM u"""


def in_zone(spark, sf):
    d = S.select_in_zone(hybrid_pool(spark, sf), 5).select("query_id", "chunk_id", "source_name", "score", F.col("rank").cast("long").alias("rank"))
    return rounded(d, "score")


ZONE_SQL = f"""WITH {HYBRID_SQL}, z AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM hyb) WHERE score >= top - 0.12),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, source_name ORDER BY score DESC, chunk_id) > CASE priority WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS INTEGER) AS ov FROM z),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ov, score DESC, chunk_id) AS pick FROM o)
SELECT query_id, chunk_id, source_name, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p WHERE pick <= 5"""


def diverse(spark, sf):
    d = S.select_diverse(hybrid_pool(spark, sf), 5).select("query_id", "chunk_id", "source_name", "score", F.col("rank").cast("long").alias("rank"))
    return rounded(d, "score")


DIVERSE_SQL = f"""WITH {HYBRID_SQL}, z AS (SELECT h.*, row_number() OVER (PARTITION BY query_id, source_name ORDER BY score DESC, chunk_id) AS nth, ns, n FROM hyb h
 JOIN (SELECT query_id, count(DISTINCT source_name) AS ns, count(*) AS n FROM hyb GROUP BY 1) USING (query_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z WHERE n <= 5 OR nth <= greatest(2, 5 // ns + 1))
SELECT query_id, chunk_id, source_name, round(score, 6)::DOUBLE AS score, rank FROM p WHERE rank <= 5"""


def selected(spark, sf):
    return I.stored(spark, sf, "selected", lambda: R.low_confidence(S.select_candidates(hybrid_pool(spark, sf), 5)))


def selected_rows(spark, sf):
    return rounded(selected(spark, sf).select("query_id", "chunk_id", "source_name", "score", F.col("rank").cast("long").alias("rank"), "reserved", "low_confidence"), "score")


#: The seats, then the four passes as a fold over (pass, place): what may be chosen depends on all that has been chosen so far.
SELECT_SQL = f"""WITH RECURSIVE {HYBRID_SQL}, pr AS (SELECT query_id, chunk_id, score, coalesce(source_name, 'unknown') AS src, source_name, coalesce(priority, 99) AS prio,
 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place, score >= max(score) OVER (PARTITION BY query_id) - 0.12 AS zone FROM hyb),
ps AS (SELECT *, row_number() OVER (PARTITION BY query_id, src, zone ORDER BY score DESC, place) AS nth, min(prio) OVER (PARTITION BY query_id, src, zone) AS bp, min(place) OVER (PARTITION BY query_id, src, zone) AS seen FROM pr),
seats AS (SELECT * FROM (SELECT query_id, place, src, row_number() OVER (PARTITION BY query_id ORDER BY bp, score DESC, seen) AS seat FROM ps WHERE zone AND nth = 1 AND bp <= 2) WHERE seat <= 2),
begin_ AS (SELECT query_id, list(place ORDER BY seat) AS places, list(src ORDER BY seat) AS srcs FROM seats GROUP BY 1),
items AS (SELECT query_id, src, place, capped, CASE prio WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS cap, row_number() OVER (PARTITION BY query_id ORDER BY pass, place) AS step
 FROM ps JOIN (VALUES (1, true, true), (2, true, false), (3, false, true), (4, false, false)) p(pass, z, capped) ON p.z = zone),
fold AS (SELECT q.query_id, 0::BIGINT AS step, coalesce(places, []::BIGINT[]) AS places, coalesce(srcs, []::VARCHAR[]) AS srcs FROM (SELECT DISTINCT query_id FROM ps) q LEFT JOIN begin_ b ON b.query_id = q.query_id
 UNION ALL SELECT f.query_id, i.step, CASE WHEN len(places) < 5 AND NOT list_contains(places, place) AND (NOT capped OR len(list_filter(srcs, lambda s: s = src)) < cap) THEN list_append(places, place) ELSE places END,
 CASE WHEN len(places) < 5 AND NOT list_contains(places, place) AND (NOT capped OR len(list_filter(srcs, lambda s: s = src)) < cap) THEN list_append(srcs, src) ELSE srcs END
 FROM fold f JOIN items i ON i.query_id = f.query_id AND i.step = f.step + 1),
chosen AS (SELECT query_id, unnest(places[1:5]) AS place, unnest(range(len(places[1:5]))) AS pick FROM (SELECT query_id, arg_max(places, step) AS places FROM fold GROUP BY 1)),
sel AS (SELECT s.query_id, s.chunk_id, s.source_name, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, pick) AS rank, t.place IS NOT NULL AS reserved, max(s.score) OVER (PARTITION BY s.query_id) < 0.45 AS low_confidence
 FROM ps s JOIN chosen c ON c.query_id = s.query_id AND c.place = s.place LEFT JOIN seats t ON t.query_id = s.query_id AND t.place = s.place)"""


def search(spark, sf):
    from tidemark.plans.search import search as run

    corpus = chunks(spark, sf).join(vectors(spark, sf).drop("label"), "chunk_id", "left")
    return run(label_queries(spark, sf), corpus, top_k=5, threshold=0.1, terms=term_index(spark, sf)).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "low_confidence")


def zone_top(spark, sf):
    """Small context base with an SQL twin: the in-zone selection."""
    return S.select_in_zone(hybrid_pool(spark, sf), 5)


def confidence(spark, sf):
    d = R.low_confidence(zone_top(spark, sf), 0.6)
    return d.groupBy("query_id").agg(F.round(F.max("score"), 6).alias("top"), F.first("low_confidence").alias("low_confidence"))


def context(spark, sf):
    d = R.low_confidence(zone_top(spark, sf), 0.0).withColumn("filename", F.col("source_name")).withColumn("page", F.col("priority"))
    return E.pack_context(d, budget=1500.0).select("query_id", "pieces", F.md5("context").alias("digest"))


ZONE_CTE = ZONE_SQL.replace("SELECT query_id, chunk_id, source_name, round(score, 6)::DOUBLE AS score, row_number()", ", zt AS (SELECT query_id, chunk_id, source_name, priority, content, score, row_number()") + ")"
CJK_SQL = f"(length(content) - length(regexp_replace(content, {quote(X.CJK)}, '', 'g')))"
CONTEXT_SQL = f"""{ZONE_CTE}, cost AS (SELECT *, sum({CJK_SQL} * 2 + (length(content) - {CJK_SQL}) * 0.25) OVER (PARTITION BY query_id ORDER BY rank) <= 1500 AS fits FROM zt),
opened AS (SELECT *, bool_and(fits) OVER (PARTITION BY query_id ORDER BY rank) AS open FROM cost)
SELECT query_id, count(*) FILTER (open) AS pieces, md5(coalesce(string_agg(content || chr(10) || '【来源：' || source_name || ' 第 ' || priority || ' 页】', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) FILTER (open), '')) AS digest FROM opened GROUP BY 1"""


def thresholds(spark, sf):
    v, _ = pools(spark, sf)
    return R.counts_by_threshold(v, [0.2, 0.4, 0.6, 0.8])


# ---- evaluation

def specs(spark, sf):
    """Labelled queries from the tables: two sources of the documents with the label's vectors, the words of the text."""
    src = vectors(spark, sf).join(chunks(spark, sf), "chunk_id").groupBy(F.col("label").cast("long").alias("query_id")).agg(
        F.min("source_name").alias("a"), F.max("source_name").alias("b"))
    words = keyword_queries(spark, sf).select("query_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("must_terms"), F.length("text").alias("n"))
    return src.join(words, "query_id").select(
        "query_id", F.when(F.col("n") > 200, "long").otherwise("short").alias("kind"), F.array("a", "b").alias("expect_sources"), "must_terms")


SPECS_SQL = """specs AS (SELECT query_id, CASE WHEN n > 200 THEN 'long' ELSE 'short' END AS kind, [a, b] AS expect, w AS must FROM
 (SELECT CAST(label AS BIGINT) AS query_id, min(source_name) AS a, max(source_name) AS b FROM embeddings JOIN chunks ON chunk_id = vec_id GROUP BY 1)
 JOIN (SELECT item_id AS query_id, list_distinct(string_split(lower(text), ' ')) AS w, length(text) AS n FROM benchmark) USING (query_id))"""
JUDGE_SQL = f"""{ZONE_CTE}, {SPECS_SQL}, r AS (SELECT z.*, kind, must, list_contains(expect, source_name) AS ok, list_filter(must, lambda t: contains(lower(content), lower(t))) AS found FROM zt z JOIN specs USING (query_id)),
per AS (SELECT query_id, bool_or(ok) FILTER (rank = 1) AS h1, bool_or(ok) AS hk, min(rank) FILTER (ok AND len(found) > 0) AS fu, max(score) FILTER (rank = 1) AS ts, max(source_name) FILTER (rank = 1) AS tsrc,
 len(list_distinct(flatten(list(found)))) AS nf FROM r GROUP BY 1),
judged AS (SELECT s.query_id, kind, coalesce(h1, false) AS source_hit_at_1, coalesce(hk, false) AS source_hit_at_k, fu AS rank_first_usable, fu IS NOT NULL AS usable_at_k,
 round(coalesce(nf / greatest(len(must), 1), 0.0), 4)::DOUBLE AS kw_recall, coalesce(ts, 0.0) AS top1_score, coalesce(tsrc, '<empty>') AS top1_source FROM specs s LEFT JOIN per USING (query_id))"""


def judged(spark, sf):
    return Q.judge_queries(zone_top(spark, sf), specs(spark, sf))


def judged_rows(spark, sf):
    return rounded(judged(spark, sf).drop("low_confidence"), "top1_score").withColumn("rank_first_usable", F.col("rank_first_usable").cast("long"))


def summary(spark, sf):
    d = Q.summarise_queries(judged(spark, sf))
    return rounded(d, "source_hit_at_1", "source_hit_at_k", "usable_at_k", "kw_recall", "mrr", "top1_score_mean", "top1_score_min", "low_conf_ratio")


SUMMARY_SQL = f"""{JUDGE_SQL} SELECT kind, count(*) AS n, round(avg(source_hit_at_1::INT), 6) AS source_hit_at_1, round(avg(source_hit_at_k::INT), 6) AS source_hit_at_k, round(avg(usable_at_k::INT), 6) AS usable_at_k,
 round(avg(kw_recall), 6) AS kw_recall, round(coalesce(avg(1.0 / rank_first_usable), 0.0), 6)::DOUBLE AS mrr, round(avg(top1_score), 6) AS top1_score_mean, round(min(top1_score), 6) AS top1_score_min, 0.0::DOUBLE AS low_conf_ratio
 FROM judged GROUP BY GROUPING SETS ((kind), ())"""


def shares(spark, sf):
    return rounded(Q.source_share(zone_top(spark, sf)), "share")


def run_compare(spark, sf):
    v, _ = pools(spark, sf)
    before = Q.judge_queries(S.select_in_zone(v, 5), specs(spark, sf))
    d = Q.compare_runs(before, judged(spark, sf))
    return d.select("query_id", "in_both", "changed", "regression")


COMPARE_SQL = (JUDGE_SQL + """, zb AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM vpool) WHERE score >= top - 0.12),
ob AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, source_name ORDER BY score DESC, chunk_id) > CASE priority WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS INTEGER) AS ov FROM zb),
pb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ov, score DESC, chunk_id) AS pick FROM ob),
ztb AS (SELECT query_id, chunk_id, source_name, content, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pb WHERE pick <= 5),
rb AS (SELECT z.*, kind, must, list_contains(expect, source_name) AS ok, list_filter(must, lambda t: contains(lower(content), lower(t))) AS found FROM ztb z JOIN specs USING (query_id)),
perb AS (SELECT query_id, min(rank) FILTER (ok AND len(found) > 0) AS fu, max(score) FILTER (rank = 1) AS ts, max(source_name) FILTER (rank = 1) AS tsrc, len(list_distinct(flatten(list(found)))) AS nf FROM rb GROUP BY 1),
jb AS (SELECT s.query_id, fu, round(coalesce(nf / greatest(len(must), 1), 0.0), 4)::DOUBLE AS kw, coalesce(ts, 0.0) AS ts, coalesce(tsrc, '<empty>') AS tsrc FROM specs s LEFT JOIN perb USING (query_id))
SELECT query_id, true AS in_both, (fu IS DISTINCT FROM rank_first_usable OR kw <> kw_recall OR ts <> top1_score OR tsrc <> top1_source) AS changed,
 ((fu IS NOT NULL AND rank_first_usable IS NULL) OR kw_recall < kw - 1e-9 OR coalesce(rank_first_usable, 99) > coalesce(fu, 99)) AS regression FROM jb JOIN judged USING (query_id)""")


def bake_off(spark, sf):
    """The same queries through three pipelines; the pipeline is a grouping key."""
    v, k = pools(spark, sf)
    corpus = chunks(spark, sf).select("chunk_id", "content", "source_name", "priority")
    kk = R.top_n(k, 40).drop("rank").join(v.select("query_id").distinct(), "query_id", "left_semi")
    runs = {"vector": v.select("query_id", "chunk_id", "score"), "keyword": kk, "rrf": R.reciprocal_rank_fusion(v, kk)}
    out = None
    for name, d in runs.items():
        top = R.top_n(d, 5).join(corpus, "chunk_id")
        j = Q.judge_queries(top, specs(spark, sf)).select(F.lit(name).alias("pipeline"), "usable_at_k", "kw_recall", "rank_first_usable")
        out = j if out is None else out.unionByName(j)
    return out.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("usable_at_k").cast("double")), 6).alias("usable"),
                                       F.round(F.avg("kw_recall"), 6).alias("kw_recall"), F.round(F.coalesce(F.avg(1.0 / F.col("rank_first_usable")), F.lit(0.0)), 6).alias("mrr"))


BAKE_OFF_SQL = f"""WITH {BM25_SQL}, {VPOOL_SQL}, {top_sql('kw', 40, 'ktop')}, {SPECS_SQL}, a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM vpool),
b AS (SELECT query_id, chunk_id, score, rank AS r FROM ktop WHERE query_id IN (SELECT query_id FROM vpool)),
u AS (SELECT 'vector' AS pipeline, query_id, chunk_id, score FROM vpool UNION ALL SELECT 'keyword', query_id, chunk_id, score FROM b UNION ALL
 SELECT 'rrf', coalesce(a.query_id, b.query_id), coalesce(a.chunk_id, b.chunk_id), coalesce(1.0::DOUBLE / (60 + a.r), 0.0) + coalesce(1.0::DOUBLE / (60 + b.r), 0.0) FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline, query_id ORDER BY score DESC, chunk_id) AS rank FROM u) WHERE rank <= 5),
r AS (SELECT t.*, must, list_contains(expect, source_name) AS ok, list_filter(must, lambda x: contains(lower(content), lower(x))) AS found FROM t JOIN chunks USING (chunk_id) JOIN specs USING (query_id)),
per AS (SELECT pipeline, query_id, min(rank) FILTER (ok AND len(found) > 0) AS fu, len(list_distinct(flatten(list(found)))) AS nf FROM r GROUP BY 1, 2),
g AS (SELECT DISTINCT pipeline, query_id, must FROM (SELECT DISTINCT pipeline FROM u), specs),
j AS (SELECT pipeline, fu, round(coalesce(nf / greatest(len(must), 1), 0.0), 4)::DOUBLE AS kw FROM g LEFT JOIN per USING (pipeline, query_id))
SELECT pipeline, count(*) AS n, round(avg(CAST(fu IS NOT NULL AS INTEGER)), 6) AS usable, round(avg(kw), 6) AS kw_recall, round(coalesce(avg(1.0 / fu), 0.0), 6)::DOUBLE AS mrr FROM j GROUP BY 1"""


# ---- answers

def answers(spark, sf):
    """Answers with sections, built from every conversation turn."""
    return I.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), "conv_id", "turn", "role",
        F.concat(F.lit("intro\n**【可能原因】**\n"), F.col("text"), F.lit("\n# note\n**建议：**\n- "), F.col("role"), F.lit("\n**【紧急程度】**\n"),
                 F.when(F.col("role") == "assistant", "高").otherwise("低")).alias("answer"))


def sections(spark, sf):
    d = E.parse_sections(answers(spark, sf), "answer_id")
    return d.select("answer_id", "section", F.md5("body").alias("digest"))


SECTIONS_SQL = f"""WITH a AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS answer_id, text, role FROM conversations),
l AS (SELECT answer_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT answer_id, string_split(text, chr(10)) AS x FROM a)),
b AS (SELECT answer_id, string_agg(line, chr(10) ORDER BY i) AS body FROM l WHERE {strip_sql('line')} <> '' AND NOT starts_with({strip_sql('line')}, '#') GROUP BY 1)
SELECT answer_id, '可能原因' AS section, md5({strip_sql('body')}) AS digest FROM b UNION ALL SELECT answer_id, '建议措施', md5('- ' || role) FROM a
UNION ALL SELECT answer_id, '紧急程度', md5(CASE WHEN role = 'assistant' THEN '高' ELSE '低' END) FROM a"""


#: Answers whose headings SQL detects as well: numbered, bold, in brackets, naming two sections, coming twice, none.
RAW_PARTS = {0: ("intro\n\n**1. 异常通道分析**\n", "\n**异常类型与可能原因**：\n- a\n\n**2 b**\n", "\n**【来源】**"), 1: ("", "\n【建议】\nfirst\n  **建议措施**  \n second \n**其他**\nrest ", "\n- **结论**\nno"), 2: ("", " ", "")}


def raw_sections(spark, sf):
    a = I.table(spark, sf, "conversations")
    piece = lambda n: F.element_at(F.array(*[F.lit(RAW_PARTS[k][n]) for k in range(3)]), (F.col("turn") % 3 + 1).cast("int"))
    a = a.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), F.concat(piece(0), "text", piece(1), "role", piece(2)).alias("answer"))
    return E.raw_sections(a, "answer_id").select("answer_id", "section", F.md5("body").alias("body"), F.md5("metric").alias("metric"))


def _raw_sql():
    def piece(n):
        return "CASE turn % 3 " + " ".join(f"WHEN {k} THEN {quote(v[n])}" for k, v in RAW_PARTS.items()) + " END"
    rows = ", ".join(f"({i}, {quote(c)}, {quote(a)})" for i, (c, aliases) in enumerate(E.SECTIONS.items()) for a in aliases)
    bare = strip_sql("line")
    return rf"""WITH a AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS answer_id, {piece(0)} || text || {piece(1)} || role || {piece(2)} AS answer FROM conversations),
l AS (SELECT answer_id, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT answer_id, string_split(answer, chr(10)) AS x FROM a WHERE length(answer) > 0)),
names(o, section, alias) AS (VALUES {rows}),
h AS (SELECT DISTINCT answer_id, i, o, section FROM (SELECT *, {bare} AS b FROM l) JOIN names ON contains(replace(b, '**', ''), alias)
  WHERE (contains(b, '【') AND contains(b, '】')) OR regexp_matches(b, '^\*\*\d+\.\s') OR (regexp_matches(b, '^\*\*[^*]+\*\*\s*[:：]?') AND NOT starts_with(b, '- ') AND NOT starts_with(b, '* '))),
s AS (SELECT *, coalesce(lead(i) OVER w, 1000000000) AS until FROM h WINDOW w AS (PARTITION BY answer_id ORDER BY i, o)),
z AS (SELECT answer_id, section, i AS since, until FROM (SELECT *, row_number() OVER (PARTITION BY answer_id, section ORDER BY i DESC, o DESC) AS r FROM s) WHERE r = 1
  UNION ALL SELECT answer_id, '_header', 0, min(i) FROM s GROUP BY answer_id),
y AS (SELECT z.answer_id, section, {strip_sql("coalesce(string_agg(line, chr(10) ORDER BY i), '')")} AS body FROM z LEFT JOIN l ON l.answer_id = z.answer_id AND i >= since AND i < until GROUP BY z.answer_id, section, since),
m AS (SELECT answer_id, section, unnest(range(len(x))) AS i, unnest(x) AS line FROM (SELECT answer_id, section, string_split(body, chr(10)) AS x FROM y)),
g AS (SELECT answer_id, section, coalesce(string_agg({bare}, chr(10) ORDER BY i) FILTER ({bare} <> '' AND NOT regexp_matches({bare}, '^\*\*\d*\.?\s*[^*]+\*\*\s*[:：]?$')), '') AS metric FROM m GROUP BY 1, 2)
SELECT answer_id, section, md5(body) AS body, md5(coalesce(metric, '')) AS metric FROM y LEFT JOIN g USING (answer_id, section) WHERE section <> '_header' OR body <> ''"""


def detail(spark, sf):
    """Every third turn is a failed answer; sources and types are missing now and then."""
    a = answers(spark, sf).withColumn("answer", F.when(F.col("turn") % 3 == 2, F.concat(F.lit("检索失败 "), F.col("answer"))).otherwise(F.col("answer")))
    records = a.select("answer_id", "answer", (F.col("conv_id") / 7.0).alias("anomaly_score"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("anomaly_type"),
                       F.array(F.struct(F.when(F.col("turn") % 2 == 1, F.col("role")).alias("filename"), F.when(F.col("turn") > 0, F.col("turn")).alias("page"), F.lit(0.123456).alias("score"))).alias("sources"))
    d = E.diagnosis_detail(records, E.parse_sections(a, "answer_id"), "answer_id")
    return d.select("answer_id", "urgency", "urgency_level", F.size("shown_sections").cast("long").alias("n_sections"), F.get("shown_sections", F.lit(0))["section"].alias("first_section"),
                    "garbled", F.length("raw").cast("long").alias("raw_length"), "anomaly_score", "anomaly_type", F.concat_ws("|", F.col("sources")[0]["filename"], F.col("sources")[0]["page"], F.col("sources")[0]["score"].cast("string")).alias("source"))


DETAIL_SQL = """SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS answer_id, CASE WHEN turn % 3 = 2 THEN '中' WHEN role = 'assistant' THEN '高' ELSE '低' END AS urgency,
 CASE WHEN turn % 3 = 2 THEN 'medium' WHEN role = 'assistant' THEN 'high' ELSE 'low' END AS urgency_level, CASE WHEN turn % 3 = 2 THEN 0 ELSE 2 END::BIGINT AS n_sections, CASE WHEN turn % 3 <> 2 THEN '可能原因' END AS first_section,
 turn % 3 = 2 AS garbled, CASE WHEN turn % 3 = 2 THEN 0 ELSE length('intro' || chr(10) || '**【可能原因】**' || chr(10) || text || chr(10) || '# note' || chr(10) || '**建议：**' || chr(10) || '- ' || role || chr(10) || '**【紧急程度】**' || chr(10) || '高') END::BIGINT AS raw_length,
 round(conv_id / 7.0, 4)::DOUBLE AS anomaly_score, CASE WHEN turn % 2 = 0 THEN role ELSE '未知' END AS anomaly_type,
 CASE WHEN turn % 2 = 1 THEN role ELSE '未知文献' END || '|' || CASE WHEN turn > 0 THEN CAST(turn AS VARCHAR) ELSE '?' END || '|0.1235' AS source FROM conversations"""


def garbled(spark, sf):
    d = I.table(spark, sf, "conversations")
    return d.select("conv_id", "turn", E.garbled(F.col("text")).alias("garbled"), E.garbled_strict(F.col("text")).alias("strict"))


GARBLED_SQL = """SELECT conv_id, turn, (contains(text, '检索失败') OR contains(text, '生成失败') OR (length(text) - length(replace(text, '�', ''))) * 2 / length(text) > 0.05
 OR (length(text) > 10 AND length(regexp_replace(text, '[\\x{00}-\\x{7f}\\x{4e00}-\\x{9fff}]', '', 'g')) / length(text) > 0.3)) AS garbled,
 (contains(text, '检索失败') OR contains(text, '生成失败') OR (2 * (length(text) - length(replace(text, '�', ''))) + (length(text) - length(replace(text, '��', ''))) / 2) / length(text) > 0.05) AS strict FROM conversations"""


#: What an answer starts with, by turn: all markers, the key markers, two kinds of failure, one marker, none.
MARKED_PARTS = {0: "".join(E.MARKERS), 1: "".join(E.KEY_MARKERS), 2: "RAG ", 3: "生成失败 ", 4: E.MARKERS[0] + E.MARKERS[0], 5: ""}


def markers(spark, sf):
    a = I.table(spark, sf, "conversations").withColumn("part", ((F.col("conv_id") + F.col("turn")) % len(MARKED_PARTS) + 1).cast("int"))
    a = a.withColumn("answer", F.concat(F.element_at(F.array(*map(F.lit, MARKED_PARTS.values())), F.col("part")), "text"))
    d = a.select("role", *E.marker_hits(F.col("answer")))
    return d.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("n_markers").cast("long").alias("markers"), F.sum("n_key_markers").cast("long").alias("key_markers"),
                                 F.count_if("all_markers").alias("complete"), F.count_if("failed").alias("failed"))


def _markers_sql():
    has = {m: f"CAST(contains(answer, {quote(m)}) AS BIGINT)" for m in E.MARKERS}
    every, key = " + ".join(has.values()), " + ".join(has[m] for m in E.KEY_MARKERS)
    parts = " ".join(f"WHEN {k} THEN {quote(v)}" for k, v in MARKED_PARTS.items())
    return f"""WITH a AS (SELECT role, CASE (conv_id + turn) % {len(MARKED_PARTS)} {parts} END || text AS answer FROM conversations)
SELECT role, count(*) AS n, sum({every})::BIGINT AS markers, sum({key})::BIGINT AS key_markers, count(*) FILTER ({every} = {len(E.MARKERS)}) AS complete,
 count(*) FILTER (starts_with(answer, 'RAG') OR contains(answer, '生成失败')) AS failed FROM a GROUP BY 1"""


def forbidden(spark, sf):
    d = E.forbidden_claims(I.table(spark, sf, "documents"), "doc_id", "text", {"digits": r"[0-9]{4,}", "mail": r"[a-z0-9.]+@[a-z0-9.]+"}, ["license", "License"])
    return d.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "reason").distinct()


FORBIDDEN_SQL = """WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, line_no, 'digits' AS reason FROM l WHERE regexp_matches(line, '[0-9]{4,}') AND NOT contains(line, 'license') AND NOT contains(line, 'License')
UNION ALL SELECT doc_id, line_no, 'mail' FROM l WHERE regexp_matches(line, '[a-z0-9.]+@[a-z0-9.]+') AND NOT contains(line, 'license') AND NOT contains(line, 'License')"""


def prompts(spark, sf):
    d = I.table(spark, sf, "conversations")
    q, t = F.col("role"), F.col("text")
    return d.select("conv_id", "turn", F.md5(E.general_prompt(q, t)).alias("general"), F.md5(E.anomaly_prompt(q, F.lit("x"), t, t, F.array(F.lit("k: v")))).alias("anomaly"),
                    F.md5(E.comparison_prompt(q, t, "evolution")).alias("compare"),
                    F.md5(E.simplified_prompt(t, F.array(F.concat(F.lit("role: "), q)))).alias("simple"), E.fill("{role}/{absent}/{turn}", {"role": q, "turn": F.col("turn")}).alias("filled"), E.query_text(q, F.lit("x"), F.substring(t, 1, 5)).alias("query"), E.citation(q, F.col("turn")).alias("cite"))


PROMPTS_SQL = """SELECT conv_id, turn, md5('请对以下遥测异常进行诊断。' || chr(10) || chr(10) || '【异常信息】' || chr(10) || role || chr(10) || chr(10) || '【参考知识片段】' || chr(10) || text || chr(10) || chr(10) || '请严格按照系统提示中的7段结构输出诊断结论。') AS general,
md5('请对以下遥测异常进行诊断。' || chr(10) || chr(10) || '【异常信息】' || chr(10) || '- 通道: ' || role || chr(10) || '- 异常类型: x' || chr(10) || '- 异常描述: ' || text || chr(10) || chr(10) || '【补充信息】' || chr(10) || '- k: v' || chr(10) || chr(10) || chr(10)
 || '【参考知识片段】' || chr(10) || text || chr(10) || chr(10) || '请严格按照系统提示中的结构输出诊断结论。') AS anomaly,
md5('对比分析：' || role || chr(10) || chr(10) || '参考知识:' || chr(10) || text || chr(10) || chr(10) || '要求：列出发展演变，最多3点，每点一行，每点≤30字，禁止废话。') AS compare,
md5('请对以下遥测异常进行诊断。' || chr(10) || chr(10) || '- role: ' || role || chr(10) || chr(10) || '参考知识:' || chr(10) || text || chr(10) || chr(10) || '按【通道定位】【异常类型】【可能原因】【影响评估】【建议措施】【紧急程度】【来源】结构输出。') AS simple, role || '/未提供/' || turn AS filled,
'通道 ' || role || ' 出现 x 异常：' || substring(text, 1, 5) AS query, '[' || role || ' p.' || turn || ']' AS cite FROM conversations"""


def stored_context(spark, sf):
    d = I.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("content")))), lambda x: F.struct(x["content"].alias("content"))).alias("s"))
    return d.select("conv_id", F.md5(E.context_from_sources(F.col("s"))).alias("digest"))


def coverage(spark, sf):
    d = I.table(spark, sf, "conversations").groupBy("conv_id").agg(F.countDistinct("role").alias("n_sources"))
    return rounded(Q.coverage(d, full=2), "sources_mean")


def channel_log(spark, sf):
    d = pools(spark, sf)[0].groupBy("query_id").agg(F.max("score").alias("top_score"), F.count(F.lit(1)).alias("n_results"), F.sum(F.length("content")).alias("retrieval_ms"))
    d = Q.per_channel(d.withColumn("channel", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")))
    return rounded(d, "avg_top_score", "avg_results", "avg_ms")


def corpus_stats(spark, sf):
    """Chunks, vectors, dimension, and ids present on one side only."""
    d = chunks(spark, sf).select("chunk_id", F.lit(1).alias("c")).join(vectors(spark, sf).select("chunk_id", F.size("embedding").alias("dim")), "chunk_id", "full_outer")
    return d.agg(F.count("c").alias("chunks"), F.count("dim").alias("vectors"), F.max("dim").cast("long").alias("dimension"),
                 F.count_if(F.col("dim").isNull()).alias("without_vector"), F.count_if(F.col("c").isNull()).alias("without_chunk"))


def examples(spark, sf):
    d = chunks(spark, sf).select("chunk_id", "source_name", (F.col("priority") <= 2).alias("strong"))
    return Q.one_per_class(d, "strong", "chunk_id")


ENTRIES = [
    Entry("h02_normalise", normalised, f"SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id, {norm_sql('text')} AS t FROM documents)"),
    Entry("h03_tokens", token_stats, f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)"),
    Entry("h04_index", index_table, f"WITH {BM25_SQL}, p AS (SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY 1) SELECT token, df, cf, round(ln(1.0 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, round(avgdl, 6) AS avg_len FROM p, st"),
    Entry("h05_bm25", bm25, f"WITH {BM25_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM kw"),
    Entry("h05_bm25_without_index", bm25_without_index, f"WITH {BM25_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM kw"),
    Entry("h06_bm25_top", bm25_top, f"WITH {BM25_SQL}, {top_sql('kw', 40, 'ktop')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ktop"),
    Entry("h07_quality", quality, f"SELECT doc_id AS chunk_id, length(b) + length(b) - length(regexp_replace(b, {quote(X.CJK)}, '', 'g')) AS length, round(CASE WHEN length(b) = 0 THEN 1.0 ELSE (length(b) - length(translate(b, {quote(X.PUNCTUATION)}, ''))) / length(b) END, 6)::DOUBLE AS junk, {low_sql('text')} AS low FROM (SELECT doc_id, text, {strip_sql('text')} AS b FROM documents)"),
    Entry("h08_quality_counts", quality_counts, f"SELECT count(*) FILTER (NOT low) AS kept, count(*) FILTER (low) AS dropped FROM (SELECT {low_sql('text')} AS low FROM documents)"),
    Entry("h07_quality_labels", quality_labels, f"WITH v AS (SELECT quality AS y, CAST(NOT {low_sql('text')} AS INTEGER) AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM v) SELECT *, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM c"),
    Entry("a09_page_text", page_text, f"SELECT page_id, md5(t) AS digest, length(t) AS n FROM (SELECT page_id, {norm_sql(PAGE_SQL)} AS t FROM pages)"),
    Entry("h01_chunks", chunk_table),
    Entry("h09_unit_vectors", unit_vectors, "SELECT vec_id AS chunk_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total, 1.0::DOUBLE AS norm FROM embeddings"),
    Entry("h10_similarities", pair_similarities, f"WITH {VEC_SQL} SELECT vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS cosine, round(list_dot_product(embedding::DOUBLE[], e), 6) AS inner, round(list_distance(embedding::DOUBLE[], e), 6) AS l2 FROM embeddings JOIN labq ON query_id = label"),
    Entry("h11_top_k", top_k, f"WITH {VEC_SQL}, {top_sql('sims', 10, 't')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM t"),
    Entry("h11_top_k_l2", top_k_l2, f"WITH {VEC_SQL}, d AS (SELECT query_id, vec_id AS chunk_id, round(-list_distance(embedding::DOUBLE[], e), 9) AS score FROM labq, embeddings), {top_sql('d', 10, 't')} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM t"),
    Entry("h12_approximate", approximate),
    Entry("h13_vector_pool", vpool, f"WITH {CHUNKS_SQL}, {VPOOL_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM vpool"),
    Entry("h14_hybrid", hybrid, f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, keyword_only, round(score, 6)::DOUBLE AS score, round(keyword_match, 6) AS keyword_match FROM hyb"),
    Entry("h15_rrf", rrf, f"WITH {RRF_SQL}"),
    Entry("h16_blends", blends, BLEND_SQL),
    Entry("h17_rerank", reranked, RERANK_SQL),
    Entry("h18_in_zone", in_zone, ZONE_SQL),
    Entry("h18_select", selected_rows, f"{SELECT_SQL} SELECT query_id, chunk_id, source_name, round(score, 6)::DOUBLE AS score, rank, reserved, low_confidence FROM sel"),
    Entry("h19_diverse", diverse, DIVERSE_SQL),
    Entry("h20_low_confidence", confidence, f"{ZONE_CTE} SELECT query_id, round(max(score), 6)::DOUBLE AS top, max(score) < 0.6 AS low_confidence FROM zt GROUP BY 1"),
    Entry("h21_search", search, f"{SELECT_SQL} SELECT query_id, chunk_id, rank, round(score, 6)::DOUBLE AS score, low_confidence FROM sel"),
    Entry("h22_context", context, CONTEXT_SQL),
    Entry("h25_prompts", prompts, PROMPTS_SQL),
    Entry("h26_stored_context", stored_context, "SELECT conv_id, md5(string_agg('[片段' || r || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1"),
    Entry("h28_sections", sections, SECTIONS_SQL),
    Entry("h28_raw_sections", raw_sections, _raw_sql()),
    Entry("h29_garbled", garbled, GARBLED_SQL),
    Entry("h30_detail", detail, DETAIL_SQL),
    Entry("h31_forbidden_claims", forbidden, FORBIDDEN_SQL),
    Entry("i01_judged_queries", judged_rows, f"{JUDGE_SQL} SELECT query_id, kind, source_hit_at_1, source_hit_at_k, rank_first_usable, usable_at_k, kw_recall, round(top1_score, 6)::DOUBLE AS top1_score, top1_source FROM judged"),
    Entry("i03_summary", summary, SUMMARY_SQL),
    Entry("i04_source_share", shares, f"{ZONE_CTE} SELECT source_name, count(*) AS slots, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM zt GROUP BY 1"),
    Entry("i05_compare_runs", run_compare, COMPARE_SQL),
    Entry("i06_bake_off", bake_off, BAKE_OFF_SQL),
    Entry("i07_threshold_counts", thresholds, f"WITH {CHUNKS_SQL}, {VPOOL_SQL} SELECT query_id, t::DOUBLE AS threshold, count(*) FILTER (score >= t) AS results FROM vpool, (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS t) GROUP BY ALL"),
    Entry("i08_markers", markers, _markers_sql()),
    Entry("i09_per_channel", channel_log, f"WITH {CHUNKS_SQL}, {VPOOL_SQL}, q AS (SELECT query_id, max(score) AS s, count(*) AS n, sum(length(content)) AS ms FROM vpool GROUP BY 1) SELECT CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS channel, count(*) AS n, round(avg(s), 6) AS avg_top_score, round(avg(n), 6) AS avg_results, round(avg(ms), 6) AS avg_ms FROM q GROUP BY 1"),
    Entry("i10_coverage", coverage, "WITH d AS (SELECT conv_id, count(DISTINCT role) AS c FROM conversations GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (c > 0) AS n_with_sources, min(c) AS sources_min, max(c) AS sources_max, round(avg(c), 6) AS sources_mean, count(*) FILTER (c >= 2) AS n_full FROM d"),
    Entry("e22_corpus_stats", corpus_stats, "SELECT count(d.doc_id) AS chunks, count(e.vec_id) AS vectors, max(len(embedding)) AS dimension, count(*) FILTER (e.vec_id IS NULL) AS without_vector, count(*) FILTER (d.doc_id IS NULL) AS without_chunk FROM documents d FULL JOIN embeddings e ON doc_id = vec_id"),
    Entry("e21_examples", examples, f"""WITH {CHUNKS_SQL}, c AS (SELECT chunk_id, source_name, priority <= 2 AS strong FROM chunks), a AS (SELECT *, row_number() OVER (PARTITION BY strong ORDER BY chunk_id) AS r, row_number() OVER (ORDER BY chunk_id) AS q FROM c)
     SELECT chunk_id, source_name, strong, CASE WHEN strong THEN 'strong' ELSE 'weak' END AS example FROM a WHERE r = 1 UNION ALL SELECT chunk_id, source_name, strong, 'overall' FROM a WHERE q = 3"""),
]
