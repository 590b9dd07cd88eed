"""Retrieval for batches of queries: keyword, vector and hybrid candidates.

Corpus: ``chunk_id, content, source_name, priority[, embedding]``. Queries: ``query_id, text[, embedding]``.
The batch of queries is the small side; it is broadcast only after its size was counted. Candidates carry
``query_id, chunk_id, score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.session import cut_lineage

# Fixed values.
K1 = 1.5
B = 0.75
KEYWORD_BOOST = 0.02
KEYWORD_POOL = 40
POOL = 40
RRF_K = 60
LOW_CONFIDENCE = 0.45

MAX_BROADCAST_TERMS = 1_000_000
#: Weights of query tokens in a broadcast (16 bytes each).
TERM_BLOCK = 4_000_000
#: Scores held at once, and chunks of a part of the index.
CELLS, PART_CHUNKS = 1_000_000, 20_000
QUERY_BLOCK = 4096
#: Tokens multiplied as a matrix at most, the share of (chunk, query) pairs from which a token is, and the relative error allowed to such sums
#: (single precision over that many tokens stays below it).
COMMON, COMMON_SHARE, MARGIN = 1024, 0.002, 2e-4
#: Chunks whose tokens a worker counts at once, and whose tokens it looks up at once.
SLICE, LOOKED_UP = 512, 2500
TERM_SALTS = 64
PLACES = 9


# ---- keyword side -------------------------------------------------------------------------

def postings(chunks: DataFrame, text: str = "content", key: str = "chunk_id", only: DataFrame | None = None) -> DataFrame:
    """(token, chunk, tf, doc_len). ``only`` keeps the tokens of a small vocabulary before anything is shuffled."""
    # exploding a one-element array keeps the optimiser from repeating the token expression
    toks = chunks.select(key, F.explode(F.array(X.tokens(F.col(text)))).alias("_t"))
    flat = toks.select(key, F.size("_t").alias("doc_len"), F.explode("_t").alias("token"))
    if only is not None:
        flat = flat.join(F.broadcast(only), "token", "left_semi")
    return flat.groupBy(key, "doc_len", "token").agg(F.count(F.lit(1)).alias("tf"))


def index_statistics(chunks: DataFrame, text: str = "content", posted: DataFrame | None = None) -> DataFrame:
    """Number of chunks and mean length; chunks without tokens count too. Complete postings spare a second tokenising."""
    if posted is not None:
        held = posted.agg(F.sum("tf").alias("_t"))
        return chunks.agg(F.count(F.lit(1)).alias("n_chunks")).join(F.broadcast(held)).select(
            "n_chunks", (F.coalesce("_t", F.lit(0)) / F.col("n_chunks")).alias("avg_len"))
    return chunks.select(F.size(X.tokens(F.col(text))).alias("n")).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg("n").alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, distinct: bool = True) -> DataFrame:
    """(query_id, token, times): the production form counts a repeated token once."""
    toks = X.tokens(F.col("text"))
    flat = queries.select("query_id", F.explode(F.array_distinct(toks) if distinct else toks).alias("token"))
    return flat.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))


def _meet(posted: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Postings of the query tokens. A token may occur in a third of all chunks, so the postings side never
    shuffles by token alone: it is filtered by a broadcast, or salted when the batch is too large for one."""
    if n_terms <= MAX_BROADCAST_TERMS:
        return posted.join(F.broadcast(terms), "token")
    salted = posted.withColumn("_s", F.pmod(F.xxhash64("chunk_id"), F.lit(TERM_SALTS)))
    copies = terms.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TERM_SALTS - 1).cast("long"))))
    return salted.join(copies, ["token", "_s"]).drop("_s")


def bm25(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, distinct: bool = True,
         posted: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Score of every (query, chunk) that shares a token. ``posted``/``stats`` reuse stored index tables.

    The postings of a chunk are gathered, and a task adds up its scores: the postings are shuffled, the scores are not.
    """
    terms = cut_lineage(query_terms(queries, distinct))
    n_terms = terms.count()
    vocabulary = terms.select("token").distinct()
    if posted is None:
        # read twice below: the postings of the query tokens are stored, not tokenised again
        hit = cut_lineage(postings(chunks, only=vocabulary if n_terms <= MAX_BROADCAST_TERMS else None))
    else:
        hit = _meet(posted, vocabulary, n_terms)
    n_chunks, avg_len = (index_statistics(chunks) if stats is None else stats).select("n_chunks", "avg_len").first()
    df = hit.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighed = terms.join(df, "token").select("query_id", "token", (idf(F.lit(n_chunks), F.col("df")) * F.col("times")).alias("weight"))
    held = hit.groupBy("chunk_id").agg(F.collect_list(F.struct("doc_len", "token", "tf")).alias("_p")).select(
        "chunk_id", F.col("_p.doc_len").alias("doc_len"), F.col("_p.token").alias("tokens"), F.col("_p.tf").alias("tfs"))

    def every(batches: Iterator[pa.RecordBatch], weights: dict, names: list) -> Iterator[pa.RecordBatch]:
        for ids, totals in _totals(batches, weights, len(names), avg_len, k1, b, CELLS // 2):
            rows, places = np.nonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(places)), ids.take(pa.array(rows)), pa.array(np.round(totals[rows, places], PLACES))], names=["query_id", "chunk_id", "score"])

    return _in_tasks(held, weighed, n_chunks, every)


def top_n(scored: DataFrame, n: int, value: str = "score") -> DataFrame:
    """Best n per query with ``rank``; Spark keeps only n per query and partition before the shuffle."""
    w = W.partitionBy("query_id").orderBy(F.col(value).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def merge_top(found: DataFrame, n: int, parts: int = 32) -> DataFrame:
    """Best n per query of what tasks have found, in two steps: by query and part first, so no task merges all of a query."""
    by_part = W.partitionBy("query_id", "_part").orderBy(F.col("score").desc(), "chunk_id")
    few = found.withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts))).withColumn(
        "_at", F.row_number().over(by_part)).filter(F.col("_at") <= n).drop("_part", "_at")
    return top_n(few, n)


def chunk_terms(chunks: DataFrame, text: str = "content") -> DataFrame:
    """The index by chunk: chunk_id, doc_len, its different tokens and how often each occurs."""
    kind = dict(chunks.dtypes)["chunk_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(1).flatten().dictionary_encode()
            kinds = max(1, len(flat.dictionary))
            found, times = np.unique(np.repeat(np.arange(len(lengths)), lengths) * kinds + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            edges = pa.array(np.searchsorted(found, np.arange(len(lengths) + 1) * kinds), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(edges, flat.dictionary.take(pa.array(found % kinds)).cast(pa.string())),
                 pa.ListArray.from_arrays(edges, pa.array(times, pa.int32()))], names=["chunk_id", "doc_len", "tokens", "tfs"])

    return chunks.select("chunk_id", X.tokens(F.col(text)).alias("tokens")).mapInArrow(
        count, f"chunk_id {kind}, doc_len bigint, tokens array<string>, tfs array<int>")


class _Best:
    """The n best (score desc, id) per query of the scores that come by. Scores that can't be among them are left out at once."""

    def __init__(self, queries: int, n: int, least: float = -np.inf):
        self.n, self.queries = n, queries
        self.low = np.full(queries, least)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: queries x rows."""
        if np.isnan(scores).any():
            scores = np.where(np.isnan(scores), -np.inf, scores)  # comes last, and out as it came in
        fits = scores >= self.low[:, None]
        if scores.shape[1] > self.n and np.count_nonzero(fits) > 4 * self.n * self.queries:
            at = scores.shape[1] - self.n
            self.low = np.maximum(self.low, np.partition(scores, at, axis=1)[:, at])
            fits = scores >= self.low[:, None]
        query, row = np.nonzero(fits)
        self.take(query, ids[row], scores[query, row])

    def take(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Some scores, each with its query and id."""
        self.held.append((query, ids, scores))
        self.size += len(query)
        if self.size > 8 * self.n * max(1, self.queries):
            self._cut()

    def _cut(self) -> None:
        query, ids, scores = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((_id_ranks(ids), -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        starts = np.searchsorted(query, np.arange(self.queries))
        nth = np.arange(len(query)) - starts[query]
        last = nth == self.n - 1
        self.low[query[last]] = np.maximum(self.low[query[last]], scores[last])
        keep = nth < self.n
        self.held, self.size = [(query[keep], ids[keep], scores[keep])], int(keep.sum())

    def rows(self, names: list) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._cut()
            query, ids, scores = self.held[0]
            for at in range(0, len(query), 65_536):
                q, i, v = (c[at:at + 65_536] for c in (query, ids, scores))
                yield pa.RecordBatch.from_pydict({"query_id": [names[j] for j in q.tolist()], "chunk_id": i.tolist(), "score": np.where(np.isneginf(v), np.nan, v)})


def _id_ranks(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids, missing ones first."""
    if ids.dtype != object:
        return ids
    order = {v: n for n, v in enumerate(sorted(set(ids.tolist()), key=lambda v: (v is not None, v)))}
    return np.array([order[v] for v in ids.tolist()], dtype=np.int64)


def _entries(batch: pa.RecordBatch, known: pa.Array, avg_len: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the token and share of its weight, for the known tokens of the chunks of a batch: id, length or lengths by token, tokens, tfs."""
    ids, lengths, tokens, tfs = batch.columns[:4]
    of = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    token = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
    met = np.flatnonzero(token >= 0)
    of, token, tf = of[met], token[met], tfs.flatten().to_numpy(zero_copy_only=False)[met]
    length = lengths.flatten().to_numpy(zero_copy_only=False)[met] if pa.types.is_list(lengths.type) else lengths.to_numpy(zero_copy_only=False)[of]
    return of, token, tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * length / avg_len)) if len(met) else np.empty(0)


def _totals(batches: Iterator[pa.RecordBatch], weights: dict, queries: int, avg_len: float, k1: float, b: float, cells: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Slices of the chunks that come by as ids and scores (rows x queries, at most ``cells`` or one row). Batches: id, length or lengths by token, tokens, tfs.

    A token adds to all its chunks of a slice and all its queries at once; tokens come in their order, so a score does not depend on the slice.
    """
    known = sorted(weights)
    rows = max(1, cells // max(1, queries))
    for batch in batches:
        ids = batch.column(0)
        of, token, part = _entries(batch, pa.array(known, pa.string()), avg_len, k1, b)
        for at in range(0, len(ids), rows):
            lo, hi = np.searchsorted(of, [at, at + rows])
            totals = np.zeros((min(rows, len(ids) - at), queries))
            order = lo + np.argsort(token[lo:hi], kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(token[order]) != 0, True]) if hi > lo else [0]
            for x, y in zip(edges[:-1], edges[1:]):
                places, w = weights[known[token[order[x]]]]
                here, share = of[order[x:y]] - at, part[order[x:y]]
                if len(set(here.tolist())) == y - x:
                    totals[here[:, None], places] += share[:, None] * w
                else:  # a chunk that has the token more than once, by different lengths
                    np.add.at(totals, (here[:, None], places), share[:, None] * w)
            yield ids.slice(at, rows), totals


class _Block:
    """The best n chunks of a block of queries (places ``lo`` to ``hi``) among the batches that come by.

    All pairs are scored in single precision, common tokens as a matrix product and the others pair by pair. That sum only says which pairs may be
    among the best n, with a margin for its error; those are scored again in double precision, in the order of the tokens.
    """

    def __init__(self, lo: int, hi: int, token: np.ndarray, place: np.ndarray, weight: np.ndarray, tokens: int, n: int):
        here = np.flatnonzero((place >= lo) & (place < hi))
        token, self.place, self.weight = token[here], place[here] - lo, weight[here]
        self.lo, self.queries, self.tokens, self.n = lo, hi - lo, tokens, n
        self.starts = np.searchsorted(token, np.arange(tokens + 1))
        order = np.argsort(self.place, kind="stable")
        self.own, self.own_weight = token[order], self.weight[order]
        self.own_starts = np.searchsorted(self.place[order], np.arange(self.queries + 1))
        self.best = _Best(self.queries, n, 10.0 ** -PLACES)

    def read(self, ids: pa.Array, of: np.ndarray, token: np.ndarray, part: np.ndarray) -> None:
        asked = np.diff(self.starts)
        use = np.flatnonzero(asked[token])
        of, token, part = of[use], token[use], part[use]
        met = np.bincount(token, minlength=self.tokens) * asked
        common = np.flatnonzero(met > COMMON_SHARE * len(ids) * self.queries)
        common = common[np.argsort(-met[common], kind="stable")][:max(0, min(COMMON, 4 * CELLS // self.queries))]
        column = np.full(self.tokens, -1)
        column[common] = np.arange(len(common))
        of_weight = np.repeat(column, asked)
        inside = of_weight >= 0
        matrix = np.zeros((len(common), self.queries), np.float32)
        np.add.at(matrix, (of_weight[inside], self.place[inside]), self.weight[inside].astype(np.float32))
        rows = max(1, min(CELLS // self.queries, CELLS // max(1, len(common))))
        held = []
        for at in range(0, len(ids), rows):
            lo, hi = np.searchsorted(of, [at, at + rows])
            held.append(self._near(at, self._sums(min(rows, len(ids) - at), of[lo:hi] - at, token[lo:hi], part[lo:hi], column, matrix, asked)))
            if sum(len(query) for _, query, _ in held) > 4 * self.n * self.queries:
                held = [self._first(held)]
        row, query, _ = self._first(held)
        self._exact(ids, row, query, of, token, part)

    def _sums(self, rows: int, of: np.ndarray, token: np.ndarray, part: np.ndarray, column: np.ndarray, matrix: np.ndarray, asked: np.ndarray) -> np.ndarray:
        at = column[token]
        shares = np.zeros((rows, len(matrix)), np.float32)
        np.add.at(shares, (of[at >= 0], at[at >= 0]), part[at >= 0].astype(np.float32))
        totals = shares @ matrix if len(matrix) else np.zeros((rows, self.queries), np.float32)
        of, token, part = of[at < 0], token[at < 0], part[at < 0].astype(np.float32)
        ends, flat = np.cumsum(asked[token]), totals.reshape(-1)
        x = 0
        while x < len(of):  # as many pairs at once as there may be scores
            y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + CELLS, "right")))
            times = asked[token[x:y]]
            entry = np.repeat(np.arange(x, y), times)
            of_query = np.arange(len(entry)) + np.repeat(self.starts[token[x:y]] - (np.cumsum(times) - times), times)
            np.add.at(flat, of[entry] * self.queries + self.place[of_query], part[entry] * self.weight[of_query].astype(np.float32))
            x = y
        return totals

    def _near(self, at: int, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, queries and sums that may be among the best."""
        fits = totals >= (self.best.low * (1.0 - MARGIN)).astype(np.float32)
        if len(totals) > self.n and np.count_nonzero(fits) > 2 * self.n * self.queries:
            last = np.partition(totals, len(totals) - self.n, axis=0)[len(totals) - self.n]
            self._raise(np.arange(self.queries), last)
            fits = totals >= (self.best.low * (1.0 - MARGIN)).astype(np.float32)
        row, query = np.nonzero(fits)
        return row + at, query, totals[row, query]

    def _raise(self, query: np.ndarray, nth: np.ndarray) -> None:
        """n scores of these queries are at least so high, but for the margin and the rounding."""
        self.best.low[query] = np.maximum(self.best.low[query], nth.astype(float) * (1.0 - MARGIN) - 10.0 ** -PLACES)

    def _first(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all rows, queries and sums that were held, those that may still be among the best n."""
        row, query, near = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((-near, query))
        starts = np.searchsorted(query[order], np.arange(self.queries))
        last = order[np.arange(len(query)) - starts[query[order]] == self.n - 1]
        self._raise(query[last], near[last])
        keep = near >= (self.best.low * (1.0 - MARGIN)).astype(np.float32)[query]
        return row[keep], query[keep], near[keep]

    def _exact(self, ids: pa.Array, row: np.ndarray, query: np.ndarray, of: np.ndarray, token: np.ndarray, part: np.ndarray) -> None:
        order = np.argsort(row, kind="stable")
        row, query = row[order], query[order]
        scores, shares = np.empty(len(row)), np.full(self.tokens, 0.0)
        here, edges = np.unique(row, return_index=True)
        los, his = np.searchsorted(of, here), np.searchsorted(of, here, "right")
        for lo, hi, x, y in zip(los.tolist(), his.tolist(), edges.tolist(), [*edges[1:].tolist(), len(row)]):
            np.add.at(shares, token[lo:hi], part[lo:hi])
            first, times = self.own_starts[query[x:y]], self.own_starts[query[x:y] + 1] - self.own_starts[query[x:y]]
            begins = np.cumsum(times) - times
            at = np.arange(times.sum()) + np.repeat(first - begins, times)
            scores[x:y] = np.add.reduceat(shares[self.own[at]] * self.own_weight[at], begins)
            shares[token[lo:hi]] = 0.0
        scores = np.round(scores, PLACES)
        keep = np.flatnonzero(scores >= self.best.low[query])
        if len(keep):
            self.best.take(query[keep], _ids(ids.take(pa.array(row[keep]))), scores[keep])
            if self.best.size > 2 * self.n * self.queries:
                self.best._cut()


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as they are, missing ones as None."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return np.array(column.to_pylist(), dtype=object if column.null_count else None)


def _best_chunks(batches: Iterator[pa.RecordBatch], weights: dict, names: list, avg_len: float, n: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """The best n chunks of every query among those that come by; weights: token to places of queries and their weights.

    Queries are met block by block, and scores of a slice of chunks are held for a block in at most ``CELLS`` cells (or one chunk).
    """
    known = sorted(weights)
    token = np.repeat(np.arange(len(known)), [len(weights[t][0]) for t in known]) if known else np.empty(0, int)
    place, weight = (np.concatenate([weights[t][i] for t in known]) if known else np.empty(0, int) for i in (0, 1))
    blocks = [_Block(at, min(at + QUERY_BLOCK, len(names)), token, place, weight, len(known), n) for at in range(0, len(names), QUERY_BLOCK)]
    known = pa.array(known, pa.string())
    for batch in (whole.slice(at, LOOKED_UP) for whole in batches for at in range(0, whole.num_rows, LOOKED_UP)):
        entries = _entries(batch, known, avg_len, k1, b)
        for block in blocks:
            block.read(batch.column(0), *entries)
    for block in blocks:
        yield from block.best.rows(names[block.lo:block.lo + block.queries])


def _by_token(queries: list | pa.Array, tokens: list | pa.Array, weights: list | pa.Array) -> tuple[list, dict]:
    """Query names in order, and per token the places of its queries and their weights."""
    if not len(queries):
        return [], {}
    queries, tokens, weights = (c if isinstance(c, pa.Array) else pa.array(c) for c in (queries, tokens, weights))
    names, known = sorted(queries.unique().to_pylist()), sorted(tokens.unique().to_pylist())
    place = pc.index_in(queries, value_set=pa.array(names, queries.type)).to_numpy(zero_copy_only=False).astype(np.int64)
    token = pc.index_in(tokens, value_set=pa.array(known, tokens.type)).to_numpy(zero_copy_only=False)
    order = np.argsort(token, kind="stable")
    edges, weight = np.searchsorted(token[order], np.arange(len(known) + 1)), weights.to_numpy(zero_copy_only=False)
    return names, {t: (place[order[x:y]], weight[order[x:y]]) for t, x, y in zip(known, edges[:-1], edges[1:])}


def keyword_top(terms_of: DataFrame, queries: DataFrame, n: int, k1: float = K1, b: float = B, distinct: bool = True) -> DataFrame:
    """The n best chunks of every query with score and rank, from the index by chunk.

    Up to ``TERM_BLOCK`` weights of query tokens are broadcast as arrays, and a chunk is scored where it lies. More are never brought to the driver: queries are dealt to
    blocks by hash, the index to parts, and every part meets every block in a task. A task gives n rows per query, whatever it
    has read. Every (query, chunk) score exists only inside its task.
    """
    asked = cut_lineage(query_terms(queries, distinct))
    vocabulary = asked.select("token").distinct()
    side = F.broadcast(vocabulary) if vocabulary.count() <= MAX_BROADCAST_TERMS else vocabulary
    df = terms_of.select(F.explode("tokens").alias("token")).join(side, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n_chunks, avg_len = terms_of.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    weighed = asked.join(df, "token").select("query_id", "token", (idf(F.lit(n_chunks), F.col("df")) * F.col("times")).alias("weight"))
    index = terms_of.select("chunk_id", "doc_len", "tokens", "tfs")
    return merge_top(_in_tasks(index, weighed, n_chunks, lambda batches, weights, names: _best_chunks(batches, weights, names, avg_len, n, k1, b)), n)


def _in_tasks(index: DataFrame, weighed: DataFrame, n_chunks: int, work) -> DataFrame:
    """(query_id, chunk_id, score) that ``work`` finds for chunks (id, length, tokens, tfs) and the weights of query tokens, by broadcast or block by block."""
    kinds = dict(index.dtypes)["chunk_id"], dict(weighed.dtypes)["query_id"]
    schema = f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double"
    weighed = cut_lineage(weighed)
    n_weights = weighed.count()
    if n_weights <= TERM_BLOCK:
        rows = weighed.toArrow()
        shared = index.sparkSession.sparkContext.broadcast(_by_token(*(rows[c].combine_chunks() for c in ("query_id", "token", "weight"))))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, weights = shared.value
            if names:
                yield from work(batches, weights, names)

        return index.mapInArrow(local, schema)

    blocks, parts = -(-n_weights // TERM_BLOCK), max(1, -(-n_chunks // PART_CHUNKS))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names, weights = _by_token(*(right[c].combine_chunks() for c in ("query_id", "token", "weight")))
        found = list(work(left.select(["chunk_id", "doc_len", "tokens", "tfs"]).to_batches(), weights, names)) if names else []
        none = pa.table({"query_id": right["query_id"].slice(0, 0), "chunk_id": left["chunk_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.Table.from_batches([x.cast(none.schema) for x in found]) if found else none

    def numbered(most: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(most - 1)))

    dealt = index.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")).withColumn("block", numbered(blocks))
    told = weighed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", numbered(parts))
    return dealt.groupBy("block", "part").cogroup(told.groupBy("block", "part")).applyInArrow(meet, schema)


def keyword_scores_of(pairs: DataFrame, terms_of: DataFrame, queries: DataFrame, k1: float = K1, b: float = B, distinct: bool = True) -> DataFrame:
    """Keyword scores of given (query_id, chunk_id) pairs only."""
    asked = cut_lineage(query_terms(queries, distinct))
    vocabulary = asked.select("token").distinct()
    flat = terms_of.select("chunk_id", "doc_len", F.explode(F.arrays_zip("tokens", "tfs")).alias("_x")).select(
        "chunk_id", "doc_len", F.col("_x.tokens").alias("token"), F.col("_x.tfs").alias("tf"))
    df = flat.select("token").join(vocabulary, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n_chunks, avg_len = terms_of.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    weights = asked.join(df.select("token", idf(F.lit(n_chunks), F.col("df")).alias("idf")), "token")
    held = terms_of.join(pairs.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "doc_len", F.explode(F.arrays_zip("tokens", "tfs")).alias("_x")).select(
        "chunk_id", "doc_len", F.col("_x.tokens").alias("token"), F.col("_x.tfs").alias("tf"))
    size = k1 * (1.0 - b + b * F.col("doc_len") / F.lit(avg_len))
    part = F.col("idf") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + size) * F.col("times")
    met = pairs.select("query_id", "chunk_id").distinct().join(weights, "query_id").join(held, ["chunk_id", "token"])
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), PLACES).alias("score"))


# ---- vector side --------------------------------------------------------------------------

def _similarities(matrix: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        sq = (matrix ** 2).sum(1)[None, :] + (queries ** 2).sum(1)[:, None] - 2.0 * queries @ matrix.T
        return np.round(-np.sqrt(np.maximum(sq, 0.0)), PLACES)
    if metric == "cosine":
        a, b = np.linalg.norm(matrix, axis=1), np.linalg.norm(queries, axis=1)
        matrix, queries = matrix / np.where(a > 0, a, 1.0)[:, None], queries / np.where(b > 0, b, 1.0)[:, None]
    return np.round(queries @ matrix.T, PLACES)


def _rows_of(column: pa.Array) -> np.ndarray:
    """Matrix of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Exact nearest chunks of every query.

    Queries travel in blocks as broadcasts; each task multiplies slices of its rows with a block, at most ``CELLS`` similarities at once, and keeps a
    running top k per query, so a task emits k rows per query whatever it read. What the tasks keep is merged in two steps.
    """
    kinds = dict(corpus.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    found, block = None, []

    def run(block: list) -> DataFrame:
        names = [r["query_id"] for r in block]
        shared = corpus.sparkSession.sparkContext.broadcast(np.array([np.asarray(r["embedding"], dtype=float) for r in block]))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, rows = _Best(len(names), k), max(1, CELLS // max(1, len(names)))
            for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
                if names:
                    best.add(_ids(batch.column(0)), _similarities(_rows_of(batch.column(1)), shared.value, metric))
            yield from best.rows(names)

        return corpus.select("chunk_id", "embedding").mapInArrow(local, f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")

    for r in queries.select("query_id", "embedding").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            found = run(block) if found is None else found.unionByName(run(block))
            block = []
    if block or found is None:
        found = run(block) if found is None else found.unionByName(run(block))
    return merge_top(found, k)


def coarse_cells(corpus: DataFrame, n_cells: int = 16, seed: int = 42):
    """Corpus with a cell number, and the cell centres, by k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from tidemark.functions.vectors import unit

    points = corpus.withColumn("_v", array_to_vector(unit(F.col("embedding"))))
    model = KMeans(k=n_cells, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=10).fit(points)
    return model.transform(points).drop("_v"), np.array(model.clusterCenters())


def approximate_top_k(corpus: DataFrame, queries: DataFrame, k: int, n_cells: int = 16, n_probe: int = 4, seed: int = 42,
                      rows_per_task: int = 50_000) -> DataFrame:
    """Nearest chunks looked for in the ``n_probe`` closest cells of each query only.

    Every query goes to its cells and meets their rows there; rows of other cells are never compared. A cell of more than ``rows_per_task``
    rows is cut into salts, and its queries are copied to each.
    """
    placed, centres = coarse_cells(corpus, n_cells, seed)
    kinds = dict(corpus.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    shared = corpus.sparkSession.sparkContext.broadcast(centres)  # n_cells rows

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_rows_of(batch.column(1)) @ shared.value.T), axis=1, kind="stable")[:, :n_probe]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.tolist(), pa.list_(pa.int32()))], names=["query_id", "embedding", "cells"])

    asked = queries.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).mapInArrow(
        probes, f"query_id {kinds[1]}, embedding array<double>, cells array<int>").select("query_id", "embedding", F.explode("cells").alias("cell"))
    salts = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows_per_task).alias("_salts")))  # n_cells rows
    rows = placed.select("chunk_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "cell").join(salts, "cell").withColumn(
        "salt", F.pmod(F.xxhash64("chunk_id"), F.col("_salts"))).drop("_salts")
    asked = asked.join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))).drop("_salts")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], right.schema.field("query_id").type), "chunk_id": pa.array([], left.schema.field("chunk_id").type), "score": pa.array([], pa.float64())})
        names = right["query_id"].to_pylist()
        matrix, best = _rows_of(right["embedding"].combine_chunks()), _Best(len(names), k)
        for batch in left.to_batches(max(1, min(4096, CELLS // len(names)))):
            best.add(_ids(batch.column("chunk_id")), _similarities(_rows_of(batch.column("embedding")), matrix, "cosine"))
        return pa.Table.from_batches(list(best.rows(names)))

    found = rows.groupBy("cell", "salt").cogroup(asked.groupBy("cell", "salt")).applyInArrow(meet, f"query_id {kinds[1]}, chunk_id {kinds[0]}, score double")
    return merge_top(found, k)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top k that was found, per query."""
    got = found.select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    return exact.join(got, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


# ---- fusion of the two sides -----------------------------------------------------------------

MAX_BROADCAST_POOL = 1_000_000


def with_content(pool: DataFrame, chunks: DataFrame, judge: str | None = None) -> DataFrame:
    """Adds content, source and priority to a candidate pool.

    The pool is stored and counted; while it is small it goes to the corpus as a broadcast, so the texts are
    read in place and never shuffled. With ``judge``, a condition on the pool, ``_low`` tells whether a chunk in a row that meets it is of low
    quality: a chunk is judged once, however many queries found it, and before its text goes anywhere.
    """
    held = cut_lineage(pool)
    small = held.count() <= MAX_BROADCAST_POOL
    rows = chunks.select("chunk_id", "content", "source_name", "priority")
    if judge is not None:
        low, wanted = X.low_quality(F.col("content")), held.filter(judge).select("chunk_id").distinct()
        if small or wanted.count() <= MAX_BROADCAST_POOL:
            rows = rows.join(F.broadcast(wanted.withColumn("_asked", F.lit(True))), "chunk_id", "left")
            low = F.when(F.col("_asked"), low).otherwise(False)
        # exploding a one-element array keeps the verdict from being put off to the rows of the join
        rows = rows.select("chunk_id", "content", "source_name", "priority", F.explode(F.array(low)).alias("_low"))
    return rows.join(F.broadcast(held) if small else held, "chunk_id")


def pool_depth(top_k: int, pool: int = POOL) -> int:
    return max(pool, 8 * top_k, top_k)


def vector_pool(nearest: DataFrame, chunks: DataFrame, top_k: int, threshold: float = 0.0, pool: int = POOL,
                quality: bool = True) -> DataFrame:
    """Deep pool, then the score threshold, then the quality filter."""
    deep = nearest.filter((F.col("rank") <= pool_depth(top_k, pool)) & (F.col("score") >= threshold)).drop("rank")
    return with_content(deep, chunks, "true").filter("NOT _low").drop("_low") if quality else with_content(deep, chunks)


def hybrid_merge(vectors: DataFrame, keywords: DataFrame, chunks: DataFrame, boost: float = KEYWORD_BOOST,
                 pool: int = KEYWORD_POOL, keyword_only_factor: float = 2.0, quality: bool = True) -> DataFrame:
    """Adds ``boost * keyword / best keyword`` to vector candidates among the keyword top; keyword-only chunks
    enter at that value times ``keyword_only_factor``. A query without vector candidates gets nothing."""
    top = top_n(keywords, pool).withColumn("_best", F.max("score").over(W.partitionBy("query_id"))).select(
        "query_id", "chunk_id", F.col("score").alias("keyword_match"), (F.col("score") / F.col("_best")).alias("_kw"))
    answered = vectors.select("query_id").distinct()
    left = vectors.select("query_id", "chunk_id", F.col("score").alias("_vector"))
    both = left.join(top.join(answered, "query_id", "left_semi"), ["query_id", "chunk_id"], "full_outer")
    gain = F.lit(boost) * F.coalesce("_kw", F.lit(0.0))
    merged = both.select(
        "query_id", "chunk_id", "keyword_match", F.col("_vector").isNull().alias("keyword_only"),
        F.when(F.col("_vector").isNull(), gain * keyword_only_factor).otherwise(F.col("_vector") + gain).alias("score"))
    if not quality:
        return with_content(merged, chunks)
    return with_content(merged, chunks, "keyword_only").filter("NOT (keyword_only AND _low)").drop("_low")


def _ranked(scored: DataFrame, name: str) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.select("query_id", "chunk_id", F.row_number().over(w).alias(name))


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, k: int = RRF_K) -> DataFrame:
    """Sum of 1/(k + rank) over both lists."""
    both = _ranked(a, "_ra").join(_ranked(b, "_rb"), ["query_id", "chunk_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return both.select("query_id", "chunk_id", (part("_ra") + part("_rb")).alias("score"))


def blend(vectors: DataFrame, keywords: DataFrame, mode: str, alpha: float = 0.3, chunks: DataFrame | None = None) -> DataFrame:
    """Other fusions: ``linear`` after min-max, ``additive`` on the raw vector score, ``decay`` by keyword rank.

    With ``chunks`` a chunk that only the keywords found must pass the quality filter; the best keyword score and the ranks are those
    of the whole list all the same.
    """
    per_query = W.partitionBy("query_id")
    kw = _ranked(keywords, "_rank").join(keywords.select("query_id", "chunk_id", F.col("score").alias("_k")),
                                         ["query_id", "chunk_id"])
    pool = vectors.select("query_id", "chunk_id", F.col("score").alias("_v")).join(kw, ["query_id", "chunk_id"], "full_outer")
    best = F.max("_k").over(per_query)
    pool = pool.withColumn("_share", F.coalesce(F.col("_k") / F.when(best > 0, best).otherwise(1.0), F.lit(0.0)))
    if chunks is not None:
        poor = with_content(pool.filter("_v IS NULL").select("query_id", "chunk_id"), chunks, "true").filter("_low")
        pool = pool.join(poor.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    pool, share = pool.withColumn("_v", F.coalesce("_v", F.lit(0.0))), F.col("_share")
    low, high = F.min("_v").over(per_query), F.max("_v").over(per_query)
    spread = F.when(high > low, high - low).otherwise(1.0)
    score = {
        "linear": (1.0 - alpha) * (F.col("_v") - low) / spread + alpha * share,
        "additive": F.col("_v") + alpha * share,
        "decay": F.col("_v") + F.coalesce(alpha / F.col("_rank"), F.lit(0.0)),
    }[mode]
    return pool.select("query_id", "chunk_id", score.alias("score"))


def rerank(pool: DataFrame, second: DataFrame, mode: str, head: int = 12, alpha: float = 0.7,
           weight: float = 0.02) -> DataFrame:
    """Order by a second score table (query_id, chunk_id, score2): ``all``, ``head`` only, ``blend`` or ``bonus``."""
    per_query = W.partitionBy("query_id")
    base = _ranked(pool, "_r").join(pool.select("query_id", "chunk_id", "score"), ["query_id", "chunk_id"]).join(
        second, ["query_id", "chunk_id"], "left")

    def minmax(c: str) -> Column:
        low, high = F.min(c).over(per_query), F.max(c).over(per_query)
        return F.coalesce((F.col(c) - low) / F.when(high > low, high - low).otherwise(1.0), F.lit(0.0))

    if mode == "head":
        order = [(F.col("_r") > head).cast("int"), F.when(F.col("_r") <= head, -F.col("score2")), F.col("_r")]
        return base.withColumn("rank", F.row_number().over(per_query.orderBy(*order))).withColumn(
            "score", F.when(F.col("_r") <= head, F.col("score2")).otherwise(F.col("score"))).drop("_r", "score2")
    value = {"all": F.col("score2"), "blend": alpha * minmax("score") + (1.0 - alpha) * minmax("score2"),
             "bonus": F.col("score") + weight * minmax("score2")}[mode]
    out = base.select("query_id", "chunk_id", value.alias("score"))
    return out.withColumn("rank", F.row_number().over(per_query.orderBy(F.col("score").desc(), "chunk_id")))


def low_confidence(results: DataFrame, floor: float = LOW_CONFIDENCE) -> DataFrame:
    """Marks all results of a query whose best score is under the floor."""
    return results.withColumn("low_confidence", F.max("score").over(W.partitionBy("query_id")) < floor)


def counts_by_threshold(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Number of results per query at each score threshold, zero included."""
    tries = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    return scored.select("query_id", "score", tries).groupBy("query_id", "threshold").agg(
        F.count_if(F.col("score") >= F.col("threshold")).alias("results"))
