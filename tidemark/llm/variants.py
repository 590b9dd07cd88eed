"""Spelling variants of the words of a corpus, by blocked Gram matrices of letter counts.

Words that differ by one inserted, deleted or replaced letter have letter counts at a squared distance of one or two, and lengths that are
equal or adjacent. Letters are dealt into a few classes, balanced by how often they occur, and a word's class counts place it: two words of one edit share a
vector of class counts once a letter (of one or of both) is taken away. So a word goes to the block of its own counts, as the shorter word
of a pair, and to the blocks of its counts less one letter of each class, as the longer one or as one of two equal lengths. Inside a block
the letter counts of its words are multiplied as matrices (squared distance: two norms less twice the product); pairs at two at most
are compared letter by letter. A pair meets in one block only. A block of too many words is cut into parts, and every two parts meet
in a task of their own; the number of classes grows with the vocabulary, so that blocks stay small.

Nulls and edges: a null text has no words; a null doc_id counts as an empty one in the hash of the removed letters; repeated rows count each;
equal counts go to the word first in code-point order; an empty table gives no words. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shelf

RUN = "[A-Za-zÀ-ÿ]+"
LETTERS = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
TILE = 1024


def words_of(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n). Where ``every`` divides the hash of document and run, the run loses the letter that the hash names."""
    run = F.explode(F.regexp_extract_all(F.translate("text", string.ascii_uppercase, string.ascii_lowercase), F.lit(f"({RUN})"), F.lit(1)))
    runs = docs.select("doc_id", run.alias("run")).withColumn("h", F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, short).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def letter_classes(words: DataFrame, classes: int) -> list[str]:
    """The letters in ``classes`` groups of about equal use."""
    used = {r[0]: r[1] for r in words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect()}  # at most the alphabet
    groups, load = [""] * classes, [0] * classes
    for c in sorted(LETTERS, key=lambda c: (-used.get(c, 0), c)):
        k = load.index(min(load))
        groups[k] += c
        load[k] += used.get(c, 0)
    return groups


def _key(counts: list[Column], less: int | None = None) -> Column:
    return F.concat_ws(",", *((c - 1 if k == less else c).cast("string") for k, c in enumerate(counts)))


def blocks(words: DataFrame, groups: list[str], most: int, shelf: Shelf) -> DataFrame:
    """(key, pair, side, part, first, word, n): copies of the words for every block, or pair of parts of a block, that they belong to.

    part: 0 for the shorter words, else the class less one letter; first: whether words of the same counts are compared here.
    """
    counts = [F.length(F.translate("word", "".join(c for c in LETTERS if c not in g), "")) for g in groups]
    told = words.withColumns({f"c{k}": c for k, c in enumerate(counts)})
    cols = [F.col(f"c{k}") for k in range(len(groups))]
    first = F.coalesce(*(F.when(c > 0, F.lit(k + 1)) for k, c in enumerate(cols)))
    copies = [F.struct(_key(cols).alias("key"), F.lit(0).alias("part"), F.lit(False).alias("first"))] + [
        F.when(c > 0, F.struct(_key(cols, k).alias("key"), F.lit(k + 1).alias("part"), (first == k + 1).alias("first"))) for k, c in enumerate(cols)]
    placed = told.select("word", "n", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())).alias("c")).select("c.*", "word", "n")
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("part").alias("_top")).filter("size > 1 AND _top > 0")
    parts = sizes.select("key", F.ceil(F.col("size") / most).cast("int").alias("parts"))
    cut = placed.join(shelf.put(parts, "block-sizes"), "key").withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return cut.select("key", (low * F.col("parts") + high).alias("pair"), (F.col("own") > F.col("other")).cast("int").alias("side"), "part", "first", "word", "n",
                      (low == high).alias("alone"))


class _Letters:
    """Words as letter counts and as letters in a row, padded with -1."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        codes = np.where(codes < 0xC0, codes - ord("a"), codes - 0xC0 + 26)
        self.size = np.array([len(w) for w in words])
        row = np.repeat(np.arange(len(words)), self.size)
        # Counts of less than 2,048 have products that single precision holds exactly.
        kind = np.float32 if self.size.max() < 2048 else np.float64
        self.counts = np.bincount(row * len(LETTERS) + codes, minlength=len(words) * len(LETTERS)).reshape(len(words), -1).astype(kind)
        self.counts = self.counts[:, self.counts.any(axis=0)]
        self.norm = (self.counts * self.counts).sum(axis=1)
        self.grid = np.full((len(words), int(self.size.max()) + 1), -1, np.int8)
        self.grid[row, np.arange(len(codes)) - np.repeat(np.cumsum(self.size) - self.size, self.size)] = codes

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b, b no shorter than a, differ by one letter exactly."""
        x, y, same = self.grid[a], self.grid[b], self.size[a] == self.size[b]
        differ = x != y
        ahead = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])  # letters in front that agree
        shifted = x[:, :-1] != y[:, 1:]
        shifted &= np.arange(shifted.shape[1]) < self.size[a][:, None]
        behind = np.where(shifted.any(axis=1), shifted.shape[1] - shifted[:, ::-1].argmax(axis=1), 0)  # the end of the last that does not, moved by one
        return np.where(same, differ.sum(axis=1) == 1, (self.size[b] == self.size[a] + 1) & (behind <= ahead))


def _meet(part: np.ndarray, first: np.ndarray, side: np.ndarray, words: list[str], alone: bool):
    """Pairs (a, b) of places of near words of one block."""
    letters = _Letters(words)
    order = np.argsort(part, kind="stable")
    for i in range(0, len(order), TILE):
        a = order[i:i + TILE]
        for j in range(i, len(order), TILE):
            b = order[j:j + TILE]
            close = letters.norm[a][:, None] + letters.norm[b][None, :] - 2 * (letters.counts[a] @ letters.counts[b].T) <= 2
            x, y = np.nonzero(close)
            x, y, px = a[x], b[y], part[a][x]
            py = part[y]
            fits = (px < py) | ((px == py) & (px > 0) & first[x] & first[y])
            if i == j:
                fits &= (px < py) | (x < y)
            if not alone:
                fits &= side[x] != side[y]
            x, y = x[fits], y[fits]
            for k in range(0, len(x), 1 << 16):
                ok = letters.near(x[k:k + (1 << 16)], y[k:k + (1 << 16)])
                yield x[k:k + (1 << 16)][ok], y[k:k + (1 << 16)][ok]


def _links(batches):
    """(word, near, n) both ways for every pair found; rows sorted by (key, pair)."""
    names = ["key", "pair", "side", "part", "first", "word", "n", "alone"]

    def of(rows: pa.Table):
        words, n = rows["word"].to_pylist(), rows["n"].to_numpy()
        part, first, side = (rows[c].to_numpy() for c in ("part", "first", "side"))
        text = rows["word"].combine_chunks()
        for x, y in _meet(part, first, side, words, rows["alone"][0].as_py()):
            if len(x):
                both, to = np.concatenate([x, y]), np.concatenate([y, x])
                yield pa.RecordBatch.from_arrays([text.take(pa.array(both)), text.take(pa.array(to)), pa.array(n[to])], names=["word", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 1 << 14:
            continue
        held = yield from _whole(held, of, names, False)
    if held:
        yield from _whole(held, of, names, True)


def _whole(held: list[pa.RecordBatch], of, names: list[str], last: bool):
    """Works off the blocks that are complete; gives back the rows of the one that may go on."""
    rows = pa.Table.from_batches(held).combine_chunks()
    if not rows.num_rows:
        return []
    key, pair = rows["key"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["pair"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
    ends = np.append(starts[1:], rows.num_rows)
    done = len(starts) if last else len(starts) - 1
    for a, b in zip(starts[:done].tolist(), ends[:done].tolist()):
        yield from of(rows.slice(a, b - a))
    return [] if last else rows.slice(int(starts[-1])).combine_chunks().to_batches()


def near_words(words: DataFrame, shelf: Shelf, most: int = 2048, per_block: int = 512) -> DataFrame:
    """(word, near, near_n): every two words that differ by one letter, both ways. words: word, n; stored."""
    size = words.count()
    if not size:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Blocks get about eight times as many with every two classes more.
    classes = max(3, min(10, 2 + int(np.log2(1 + size / per_block)) // 2))
    placed = blocks(words, letter_classes(words, classes), most, shelf)
    dealt = placed.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(_links, "word string, near string, near_n bigint")


def variants(docs: DataFrame, **options) -> DataFrame:
    """Per word: word, n, n_near, form (its commonest near word of at least twice its count), form_n, root (the last of the forms)."""
    shelf = Shelf(docs.sparkSession, "variants")
    words = shelf.put(words_of(docs, **options), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    tied = shelf.put(near_words(words, shelf), "links").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    told = words.join(tied, "word", "left").withColumn("fits", -F.col("best.n") >= 2 * F.col("n"))
    told = shelf.put(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("fits"), F.col("best.near")).alias("form"),
                                 F.when(F.col("fits"), -F.col("best.n")).alias("form_n")), "forms")
    # Counts at least double along a chain, so it has few steps; each round doubles what is followed.
    step, n = shelf.put(told.filter("form IS NOT NULL").select("word", F.col("form").alias("to")), "step-0"), 0
    while True:
        further = step.select(F.col("word").alias("to"), F.col("to").alias("further"))
        after = shelf.put(step.join(further, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), f"step-{n + 1}")
        step, n = after.drop("moved"), n + 1
        if after.filter("moved").isEmpty():
            break
    return told.join(step.withColumnRenamed("to", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
