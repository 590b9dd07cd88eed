"""Substring dedup: words in windows whose word sequence starts anywhere else, found by suffix automata of shards.

A corpus is its own reference here, so automata of all of it cannot be sent to every task. The shards are therefore small and
chosen by content: every window of ``window`` words has a least hash among its runs of ``gram`` words, and equal windows have equal
least hashes. Consecutive windows with the least hash of one place form a piece. Pieces whose least hash occurs once in the corpus hold
no repeated window and are left out; the others meet at their least hash, which is a shard. A task builds the suffix automaton of a shard's
pieces, counts how often each of its states ends, and streams the pieces through it for matching statistics: the longest run ending at each
word that the shard has twice. Where that reaches the window's length, the words of the window go.

Equal texts are one text with all of its windows repeated; equal pieces are one piece with a count, from the task that reads them on.
A shard of more than ``most`` pieces is dealt out further: its windows meet one by one at a 128-bit digest of
their words, where counting is all that is left to do. The work is linear in the text in either case.

Nulls and edges: a null text has no words; texts shorter than a window lose nothing; an empty table gives no rows; repeated rows are
copies of each other and lose all windows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shelf

WINDOW, GRAM = 35, 8
#: Pieces that a task remembers to have sent, to send equal ones without their words.
REMEMBERED = 100_000
_FACTORS = np.random.default_rng(3).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _text_key(text):
    return F.unhex(F.md5(text))


def _digest(raw: bytes) -> bytes:
    return hashlib.md5(raw).digest()


def least_hashes(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(least hash, first window) of every run of windows whose least hash is that of one place."""
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = len(words) - gram + 1
    h = np.zeros(m, np.uint64)
    for j in range(gram):
        h += one[j:j + m] * _FACTORS[j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    span, have, place = window - gram + 1, 1, np.arange(m)
    while have < span:  # least of the next 1, 2, 4, ... hashes, the first of equal ones
        step = min(have, span - have)
        later = h[step:] < h[:-step]
        h, place = np.where(later, h[step:], h[:-step]), np.where(later, place[step:], place[:-step])
        have += step
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return h[first], first


def marks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Per document of a window's length or more: doc_id, key of the text, least hashes and where their runs of windows begin and end."""
    kind = dict(docs.dtypes)["doc_id"]

    def read(batches):
        for batch in batches:
            ids, keys, least, starts, n = [], [], [], [], []
            for doc_id, key, text in zip(*batch.columns):
                words = (text.as_py() or b"").split()
                if len(words) >= window:
                    h, first = least_hashes(words, window, gram)
                    ids.append(doc_id.as_py()), keys.append(key.as_py()), n.append(len(words) - window + 1)
                    least.append(h.view(np.int64)), starts.append(first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(least, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32()))],
                names=["doc_id", "key", "n", "least", "starts"])

    return docs.select("doc_id", _text_key(F.col("text")), F.col("text").cast("binary")).mapInArrow(
        read, f"doc_id {kind}, key binary, n int, least array<bigint>, starts array<int>")


def _cut(batches, window: int):
    """text, rid, spots (start, end, least, hot) -> pieces: rid, start, shard, content, words (null if the task has sent them), length."""
    sent: set[bytes] = set()
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["rid", "start", "shard", "content", "words"]
    for batch in batches:
        rows: list[tuple] = []
        for rid, text, spots in zip(*batch.columns):
            words, rid = text.as_py().split(), rid.as_py()
            for s in spots.as_py():
                a, b = s["start"], s["end"]
                if s["hot"]:
                    for i in range(a, b):
                        content = _digest(b" ".join(words[i:i + window]))
                        rows.append((rid, i, content, content, None))
                    continue
                joined = b" ".join(words[a:b + window - 1])
                content = _digest(joined)
                new = content not in sent
                if new:
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(content)
                rows.append((rid, a, s["least"].to_bytes(8, "little", signed=True), content, joined if new else None))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


class SuffixAutomaton:
    """Of several word sequences, each with a number of occurrences; no match runs across two of them."""

    def __init__(self, sequences: list[tuple[list, int]]):
        nexts, link, length, ends, last, apart = [{}], [-1], [0], [0], 0, 0
        for words, times in sequences:
            apart -= 1
            for w in [*words, apart]:  # a number of its own closes each sequence
                cur = len(nexts)
                nexts.append({})
                length.append(length[last] + 1)
                ends.append(times if w.__class__ is not int else 0)
                p = last
                while p >= 0 and w not in nexts[p]:
                    nexts[p][w] = cur
                    p = link[p]
                if p < 0:
                    link.append(0)
                else:
                    q = nexts[p][w]
                    if length[p] + 1 == length[q]:
                        link.append(q)
                    else:
                        copy = len(nexts)
                        link.append(copy)
                        nexts.append(nexts[q].copy())
                        length.append(length[p] + 1)
                        ends.append(0)
                        link.append(link[q])
                        while p >= 0 and nexts[p].get(w) == q:
                            nexts[p][w] = copy
                            p = link[p]
                        link[q] = copy
                last = cur
        order = np.argsort(np.array(length), kind="stable")[::-1].tolist()
        for v in order:
            if link[v] > 0:
                ends[link[v]] += ends[v]
        # The longest run of each state, or of the suffixes above it, that occurs twice.
        twice = [0] * len(nexts)
        for v in reversed(order):
            if v:
                twice[v] = length[v] if ends[v] > 1 else twice[link[v]]
        self.nexts, self.link, self.length, self.twice = nexts, link, length, twice

    def statistics(self, words: list) -> list[int]:
        """For each word, the longest run ending there that the sequences have at least twice."""
        state, matched, found = 0, 0, []
        nexts, link, length, twice = self.nexts, self.link, self.length, self.twice
        for w in words:
            while state and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if w in nexts[state]:
                state = nexts[state][w]
                matched += 1
            else:
                state = matched = 0
            found.append(min(matched, twice[state]))
        return found


def _repeated(pieces: list[tuple[bytes, bytes, int]], window: int):
    """(content, ranges of repeated windows' words) of a shard's distinct pieces (content, words, count)."""
    if len(pieces) == 1 and pieces[0][2] > 1:
        yield pieces[0][0], [(0, len(pieces[0][1].split()))]
        return
    split = [(content, joined.split(), n) for content, joined, n in pieces]
    automaton = SuffixAutomaton([(words, n) for _, words, n in split])
    for content, words, n in split:
        if n > 1:
            yield content, [(0, len(words))]
            continue
        ranges: list[tuple[int, int]] = []
        for i, run in enumerate(automaton.statistics(words)):
            if run >= window:
                a = i + 1 - window
                if ranges and a <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], i + 1)
                else:
                    ranges.append((a, i + 1))
        if ranges:
            yield content, ranges


def _shards(batches, window: int):
    """shard, content, words, sorted by the first two -> content, ranges."""
    shard, pieces = None, {}

    def done():
        rows = list(_repeated([(c, w, n) for c, (w, n) in pieces.items()], window)) if pieces else []
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in rows], pa.binary()), pa.array([[{"a": a, "b": b} for a, b in r] for _, r in rows], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
            names=["content", "ranges"])

    for batch in batches:
        for s, content, words, n in zip(*(c.to_pylist() for c in batch.columns)):
            if s != shard:
                if pieces:
                    yield done()
                shard, pieces = s, {}
            known, count = pieces.get(content, (None, 0))
            pieces[content] = (known or words, count + n)
    if pieces:
        yield done()


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = 2048, shelf: Shelf | None = None) -> DataFrame:
    """(key, ranges): per text with repeated windows, the word ranges that they cover, unmerged and in no order."""
    shelf = shelf or Shelf(docs.sparkSession, "substrings")
    found = marks(docs, window, gram).groupBy("key").agg(
        F.first("least").alias("least"), F.first("starts").alias("starts"), F.first("n").alias("n"), F.min("doc_id").alias("writer"), F.count(F.lit(1)).alias("copies"))
    once = shelf.put(found.withColumn("rid", F.monotonically_increasing_id()), "texts")
    runs = once.select("rid", "n", "starts", F.posexplode("least").alias("i", "least")).select(
        "rid", "least", F.element_at("starts", F.col("i") + 1).alias("start"), F.coalesce(F.try_element_at("starts", F.col("i") + 2), F.col("n")).alias("end"))
    # Stored, so that the join with it has two plain exchanges and a least hash that many texts have can be split.
    common = shelf.put(runs.groupBy("least").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1"), "common")
    spots = runs.join(common, "least").groupBy("rid").agg(
        F.collect_list(F.struct("start", "end", "least", (F.col("pieces") > most).alias("hot"))).alias("spots"))
    asked = once.select("rid", "key", "writer").join(spots, "rid")
    cut = docs.select("doc_id", F.col("text").cast("binary").alias("text"), _text_key(F.col("text")).alias("_key")).join(
        asked, (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("writer"))).select("rid", "text", "spots")
    pieces = shelf.put(cut.mapInArrow(lambda b: _cut(b, window), "rid bigint, start int, shard binary, content binary, words binary"), "pieces", codec="zstd")

    # Windows of large shards are their own content and only counted; pieces meet at their shard.
    single = pieces.filter("shard = content").groupBy("content").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "content", F.array(F.struct(F.lit(0).alias("a"), F.lit(window).alias("b"))).alias("ranges"))
    counted = pieces.filter("shard <> content").withColumn("n", F.lit(1))
    dealt = counted.select("shard", "content", "words", "n").repartition("shard").sortWithinPartitions("shard", "content")
    matched = dealt.mapInArrow(lambda b: _shards(b, window), "content binary, ranges array<struct<a:int,b:int>>")
    # Stored, so that the join below has two plain exchanges and a content that many texts have can be split.
    ranges = shelf.put(matched.groupBy("content").agg(F.flatten(F.collect_set("ranges")).alias("ranges")).unionByName(single), "matches")
    hits = pieces.select("rid", "start", "content").join(ranges, "content").select("rid", F.transform("ranges", lambda r: F.struct(
        (F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"]).alias("b"))).alias("ranges"))
    whole = once.filter("copies > 1").select("rid", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + window - 1).alias("b"))).alias("ranges"))
    by_text = hits.unionByName(whole).groupBy("rid").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return once.select("rid", "key").join(by_text, "rid").select("key", "ranges")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = 2048, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256; with ``texts`` also kept_text, the kept words joined by one space.

    most: pieces that one automaton is built of, at most.
    """
    shelf = Shelf(docs.sparkSession, "substrings")
    kind = dict(docs.dtypes)["doc_id"]
    removed = repeated_ranges(docs, window, gram, most, shelf).withColumnRenamed("key", "_key")

    def keep(batches):
        for batch in batches:
            n, gone, sha, kept_texts = [], [], [], []
            for _, text, ranges in zip(*batch.columns):
                words = (text.as_py() or b"").split()
                n.append(len(words))
                if ranges.is_valid and len(ranges):
                    drop = np.zeros(len(words) + 1, np.int64)
                    for r in ranges.as_py():
                        drop[r["a"]] += 1
                        drop[r["b"]] -= 1
                    words = [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist()) if not d]
                gone.append(n[-1] - len(words))
                kept = b" ".join(words)
                sha.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept.decode("utf-8", "replace"))
            more = [pa.array(kept_texts, pa.string())] if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *more],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts])

    met = docs.select("doc_id", F.col("text").cast("binary").alias("text"), _text_key(F.col("text")).alias("_own")).join(
        removed, F.col("_own") == F.col("_key"), "left").select("doc_id", "text", "ranges")
    return met.mapInArrow(keep, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts)
