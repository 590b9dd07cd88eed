"""Links between texts by the exact Jaccard similarity of their shingle sets.

A shingle set is the distinct runs of ``shingle`` lower-case words, held as 64-bit hashes. Texts of equal sets are one class. A class has 256 least hashes of its set;
six of them make a band, and classes that share one of 42 bands meet in a bucket. Two sets of similarity 0.8 share a band with a
probability of 0.999997. A pair of a bucket is tried when

* the sizes allow the similarity, and one bit of each least hash differs in no more than six deviations above the mean;
* the parities allow it: a set has 512 parities of its hashes by their last nine bits. An element that only one of two sets has turns one parity, so
  the parities that differ are no more than the elements that differ. This bound loses no link, and it holds back the pairs of a large group
  whose members are all close to one text but not to each other.

A link is what the sets themselves say. The trials of a bucket stay near its size: its members are tried against its most central member first (that with
the fullest buckets), then what is not of its component against the most central of the rest, while that links one in twenty. Then all
pairs of members of different components are tried, in cells of two parts of a bucket, each in the first bucket that the two share. So every pair
of a bucket is tried or joined by others.

Nulls and edges: null and empty texts have the empty set and are one class; a text of fewer words than a shingle has one shingle of all of them;
equal texts, and texts that differ in case, spacing or repeated shingles only, are one class; ties go to the smaller id; empty tables give empty
results. Long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shelf, small
from tidemark.llm.components import components

LEAST, BANDS, ROWS = 256, 42, 6
#: The bit of a least hash that is kept; far enough down to be even in the least of many.
BIT = np.uint64(30)
#: Parities of a set, most rounds of trials against hubs, and members of a part of a bucket.
PARITIES, HUBS, PART = 512, 6, 4096
#: Rows that a worker holds the facts of at once.
SLICE = 512
_RANDOM = np.random.default_rng(64)
_FACTORS = _RANDOM.integers(0, 2**64, LEAST, dtype=np.uint64) | np.uint64(1)
_TERMS = _RANDOM.integers(0, 2**64, LEAST, dtype=np.uint64)
_BITS = [f"bits{n}" for n in range(LEAST // 64)]
_ODD = [f"odd{n}" for n in range(PARITIES // 64)]


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """Of each of 256 hash functions the least value over a set."""
    least = np.full(LEAST, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, at:at + 1024] * _FACTORS[:, None] + _TERMS[:, None]).min(axis=1), out=least)
    return least


def hashed(text: bytes | None, shingle: int) -> np.ndarray:
    """The shingle set as sorted hashes; the shingles themselves are never held together."""
    words = (text or b"").lower().split()
    k = min(shingle, len(words))
    n = len(words) - k + 1 if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + k])) for i in range(n)), np.uint64, n))


def marks(text: bytes | None, shingle: int) -> tuple[bytes, int, np.ndarray, np.ndarray, list[int]]:
    """Digest and size of the shingle set, a bit of each least hash and the parities as words, the bands' keys."""
    hashes = hashed(text, shingle)
    least = least_hashes(hashes)
    bits = np.packbits(((least >> BIT) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    odd = np.packbits((np.bincount((hashes % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)
    keys = [xxhash.xxh64_intdigest(least[ROWS * n:ROWS * (n + 1)].tobytes(), n) for n in range(BANDS)]
    return xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), bits, odd, keys


def marked(docs: DataFrame, shingle: int, fingerprint: Callable[[bytes | None], int]) -> DataFrame:
    """The columns of ``docs`` (text as bytes) and digest, size, bits0 to bits3, odd0 to odd7, keys of each text's set and fp, its unsigned ``fingerprint`` as a signed number."""
    given = docs.withColumn("text", F.col("text").cast("binary"))
    at, names = given.columns.index("text"), [*given.columns, "digest", "size", *_BITS, *_ODD, "keys", "fp"]

    def rows(batches):
        for batch in (whole.slice(n, SLICE) for whole in batches for n in range(0, whole.num_rows, SLICE)):
            found = [(*marks(t.as_py(), shingle), fingerprint(t.as_py())) for t in batch.column(at)]
            words = np.array([np.concatenate(f[2:4]) for f in found], np.int64).reshape(len(found), -1)
            keys = np.array([f[4] for f in found], np.uint64).view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int32()), *(pa.array(words[:, n].copy()) for n in range(len(_BITS) + len(_ODD))),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(keys)), pa.array(np.array([f[5] for f in found], np.uint64).view(np.int64))], names=names)

    given_types = ", ".join(f"{c} {kind}" for c, kind in given.dtypes)
    return given.mapInArrow(rows, f"{given_types}, digest binary, size int, " + ", ".join(f"{b} bigint" for b in [*_BITS, *_ODD]) + ", keys array<bigint>, fp bigint")


def bits_apart(similarity: float) -> int:
    """Bits of the least hashes in which sets of this similarity differ on average, and six deviations."""
    p = (1 - similarity) / 2
    return math.ceil(LEAST * p + 6 * math.sqrt(LEAST * p * (1 - p)))


def likely(similarity: float) -> Column:
    """Of rows with the facts of two sets x and y."""
    def differ(words: list[str]) -> Column:
        return sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in words), F.lit(0))

    apart = (F.col("x.size") + F.col("y.size")) * (1 - similarity) / (1 + similarity) + 1e-6
    return (F.least("x.size", "y.size") / F.greatest("x.size", "y.size") >= similarity) & (differ(_BITS) <= bits_apart(similarity)) & (differ(_ODD) <= apart)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have this Jaccard similarity or more. pairs: distinct; sets: id, hashes (sorted); both stored.

    While the pairs' counted size permits, they are broadcast to the sets: then only the sets of pairs are shuffled.
    """
    def check(batches):
        for batch in batches:
            kept = []
            for n in range(batch.num_rows):
                x, y = (batch.column(c)[n].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both / max(1, len(x) + len(y) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    told = small(pairs)
    x, y = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"_{c}")) for c in ("a", "b"))
    whole = pairs.join(y, "b").join(x, "a") if told is pairs else x.join(told, "a").join(y.join(told, "b"), ["a", "b"])
    return whole.select("a", "b", "_a", "_b").mapInArrow(check, "a bigint, b bigint")


def hash_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes) of (id, text)."""
    def rows(batches):
        for batch in (whole.slice(n, SLICE) for whole in batches for n in range(0, whole.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashed(t.as_py(), shingle).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["id", "hashes"])

    return texts.select("id", "text").mapInArrow(rows, "id bigint, hashes array<bigint>")


def roots(sets: DataFrame, classes: DataFrame, shelf: Shelf, shingle: int, similarity: float, given: DataFrame | None = None) -> DataFrame:
    """(id, root) of every class of more than itself but the roots. sets: id, text, size, bits, parities, keys; classes: ids of one row of each class; given: pairs (a, b) of
    classes to try first; all stored."""
    placed = sets.select("id", "keys").join(classes, "id", "left_semi").select("id", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = shelf.put(placed.join(shared, "key"), "met")
    buckets = shelf.put(met.join(met.groupBy("id").agg(F.sum("n").alias("central")), "id").select("key", "id", "central"), "buckets")
    ids = buckets.select("id")
    if given is not None:
        ids = ids.unionByName(given.select(F.col("a").alias("id"))).unionByName(given.select(F.col("b").alias("id")))
    held = shelf.put(ids.distinct(), "held")
    own = shelf.put(sets.join(small(held), "id", "left_semi").select("id", "text", "size", "keys", *_BITS, *_ODD), "own")
    facts, names = own.drop("text"), ["size", *_BITS, *_ODD]
    hashes = shelf.put(hash_sets(own, shingle), "hashes")
    known = None  # (id, root) by the links so far

    def tries(pairs: DataFrame, n: int | str) -> int:
        """Tries pairs (a, b) and joins the components of those that link; gives the number of links."""
        nonlocal known
        links = shelf.put(similar(shelf.put(pairs, f"pairs-{n}"), hashes, similarity), f"links-{n}")
        shelf.drop(f"pairs-{n}")
        found = links.count()
        if found and known is None:
            known = shelf.put(components(links, shelf), f"known-{n}")
        elif found:  # only the new links are worked on, between components
            def renamed(df: DataFrame, c: str) -> DataFrame:
                return df.join(known.select(F.col("id").alias(c), F.col("root").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
            moved = shelf.put(components(renamed(renamed(links, "a"), "b"), shelf), f"moved-{n}")
            further = known.join(moved.select(F.col("id").alias("root"), F.col("root").alias("_r")), "root", "left").select("id", F.coalesce("_r", "root").alias("root"))
            known = shelf.put(further.unionByName(moved.select("id", "root")), f"known-{n}")  # what moves was a root, so no id comes twice
        return found

    def with_roots(rows: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with their root and the bucket's largest one."""
        if known is not None:
            rows = rows.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
        else:
            rows = rows.withColumn("root", F.col("id"))
        several = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
            F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
        return rows.join(several, "key")

    def allowed(pairs: DataFrame) -> DataFrame:
        x, y = (facts.select(F.col("id").alias(c), F.struct(*names).alias(t)) for c, t in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b").filter(likely(similarity)).select("a", "b")

    if given is not None:
        tries(allowed(given), "given")
    for n in range(HUBS):
        open_ = shelf.put(with_roots(buckets), f"open-{n}")
        rest = open_ if n == 0 else open_.filter("root <> main")
        left = rest.select("id").distinct().count()
        if not left:
            return known if known is not None else _none(sets)
        hubs = rest.groupBy("key").agg(F.max_by(F.struct("id", "root"), F.struct("central", -F.col("id"))).alias("hub")).select("key", F.col("hub.id").alias("hub"), F.col("hub.root").alias("its"))
        pairs = rest.join(hubs, "key").filter("root <> its").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        found = tries(allowed(pairs), n)
        if 20 * found < left:
            break
    open_ = shelf.put(with_roots(buckets), "open")
    if open_.isEmpty():
        return known if known is not None else _none(sets)
    every = open_.join(facts, "id").withColumn("parts", F.ceil(F.col("members") / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = shelf.put(every.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "every")
    x = every.filter("root <> main").withColumn("cell", F.col("part") * F.col("parts") + F.col("other")).alias("x")
    y = every.withColumn("cell", F.col("other") * F.col("parts") + F.col("part")).alias("y")
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")  # the first bucket that both share
    order = (F.col("y.root") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.root") != F.col("y.root")) & order & likely(similarity))
    pairs = across.filter(once).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    tries(pairs.distinct(), HUBS)
    return known if known is not None else _none(sets)


def _none(sets: DataFrame) -> DataFrame:
    return sets.select("id", F.col("id").alias("root")).limit(0)
