"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has bit b set when over half of its shingle hashes have it. Equal fingerprints fall together
first; the trie holds each fingerprint once. The join walks pairs of trie nodes together, adds up the bits in which their prefixes
differ and drops a pair once the error budget is exceeded.

The budget grows with depth. Cut the 64 bits into ``budget + 1`` parts. Two fingerprints within the budget have, by the
pigeonhole argument on rotations, a part from which the first i parts, read round, differ in at most ``i * budget / parts`` bits, for
every i. So one trie is walked per rotation, with no error in the first part, at most one in the first two and so on.
The first part, which must be equal, deals the trie out: every (rotation, first part) is a subtree of its own. For large corpora the cut
is made deeper, until a subtree holds about ``most`` fingerprints, and a fingerprint goes to every pair of nodes at that depth that is within
the budget. A pair of nodes that still has too many fingerprints is cut into blocks by a hash, and every pair of blocks is a walk of its own.

A task keeps its node pairs on a stack in blocks of bounded size, drops pairs of nodes whose fingerprints are linked already, and gives
a spanning forest of the links that it finds, never all pairs. Components over the forests of all tasks are found by alternating large and small stars in Spark.

With ``similarity`` near_duplicates and representatives ask the texts too: the trie join proposes pairs, and a link is an exact Jaccard similarity of two sets of
shingles; least hashes find those that differ in more bits (see jaccard.py). links() alone takes it as an estimate: a link must also agree in 256 bits, the fingerprint and three more of the same shingles, about as often as two texts of that similarity do.

Nulls and edges: null and wordless texts have fingerprint zero and are linked like any other; a null doc_id never
names a component unless it has no other; repeated rows are linked; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import jaccard
from tidemark.llm.common import DOCUMENT_COLUMNS, Shelf, small
from tidemark.llm.components import components

BITS = 64
#: Further words of 64 bits that tell candidates apart when a similarity is asked for.
SKETCH = 3
#: Shingle hashes counted at once, and node pairs held at once, in a task.
HASHES, PAIRS = 1 << 16, 1 << 15
#: Every byte's bits as the lowest bits of eight bytes, most significant bit first.
_SPREAD = np.array([int.from_bytes(bytes((v >> (7 - i)) & 1 for i in range(8)), "little") for v in range(256)], dtype="<u8")


def _majority(hashes: np.ndarray, ones: np.ndarray) -> None:
    """Adds up the set bits of big-endian hashes."""
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    for start in range(0, len(hashes), 255):
        lanes = _SPREAD[by_byte[start:start + 255]].sum(axis=0, dtype=np.uint64)
        ones += lanes.astype("<u8").view(np.uint8)


def _remixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Further hash values from 64-bit ones (the finisher of splitmix64)."""
    x = hashes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * salt % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(">u8")


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42, sketch: int = 0) -> list[int]:
    """The fingerprint and ``sketch`` further words."""
    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return [0] * (1 + sketch)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones, digest = np.zeros((1 + sketch, BITS), dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[at:at + HASHES], ends[at:at + HASHES])], dtype=">u8")
        _majority(hashes, ones[0])
        for n in range(1, sketch + 1):
            _majority(_remixed(hashes, n), ones[n])
    return [int.from_bytes(np.packbits(2 * row > len(starts)).tobytes(), "big") for row in ones]


def _words(sketch: int) -> list[str]:
    return ["fp", *(f"fp{n}" for n in range(1, sketch + 1))]


def fingerprints(docs: DataFrame, shingle: int = 4, sketch: int = 0) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number, with further words as fp1, fp2, ..."""
    kind, names = dict(docs.dtypes)["doc_id"], _words(sketch)

    def marks(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, sketch=sketch) for t in batch.column(1)], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, n].copy()) for n in range(len(names)))], names=["doc_id", *names])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(marks, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names))


def part_edges(budget: int) -> list[int]:
    """Where the parts of a fingerprint end; the first parts are the longer ones."""
    n = budget + 1
    return [sum(BITS // n + (j < BITS % n) for j in range(i + 1)) for i in range(n)]


def depth_budget(budget: int, widths: list[int]) -> np.ndarray:
    """Bits that may differ down to each depth, for parts of these widths read in this order."""
    allowed, parts = [0], len(widths)
    for i, w in enumerate(widths):
        allowed += [(i + 1) * budget // parts] * w
    return np.array(allowed)


def rotations(budget: int) -> list[tuple[int, list[int]]]:
    """(bits to rotate left by, widths of the parts in that reading) for every part that may come first."""
    edges = part_edges(budget)
    widths = [b - a for a, b in zip([0, *edges], edges)]
    return [([0, *edges][i], widths[i:] + widths[:i]) for i in range(len(widths))]


def masks(allowed: np.ndarray, depth: int) -> list[int]:
    """Differences of two nodes' prefixes of this depth that are within the budget all the way down."""
    found = [0]
    for d in range(1, depth + 1):
        found = [m << 1 | bit for m in found for bit in (0, 1) if m.bit_count() + bit <= allowed[d]]
    return found


def bits_apart(similarity: float, bits: int) -> int:
    """Bits in which SimHashes of two texts of this Jaccard similarity differ on average, and half a deviation; the texts being of one length."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + 0.5 * math.sqrt(bits * p * (1 - p)))


class _Forest:
    """A spanning forest of links, by hooking roots to smaller roots; parent holds roots between calls."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.changes = np.arange(n)
        self.links = [np.empty((0, 2), dtype=np.int64)]  # those that joined two trees

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        parent = self.parent
        while len(i):
            a, b = parent[i], parent[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(parent, high, low)
            hooked = np.flatnonzero(parent[high] == low)
            first = hooked[np.unique(high[hooked], return_index=True)[1]]
            self.links.append(np.stack([i[first], j[first]], axis=1))
            while not np.array_equal(above := parent[parent], parent):
                parent[:] = above
            self.changes = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))

    def joined(self, a0, a1, b0, b1) -> np.ndarray:
        """Pairs of ranges that lie in one component."""
        c = self.changes
        return (self.parent[a0] == self.parent[b0]) & (c[a1 - 1] == c[a0]) & (c[b1 - 1] == c[b0]) & ((a0 != b0) | (a1 - a0 > 1))


def _join(keys: np.ndarray, heads: list[tuple], allowed: np.ndarray, linked, forest: _Forest) -> None:
    """Walk node pairs of the tries that sorted stretches of ``keys`` are.

    heads: (a from, a to, b from, b to, depth, bits that differ so far); a pair of a node with itself has equal ranges. linked
    says of positions which pairs link. Equal keys are cut by position below the last bit.
    """
    stack = [np.array(heads, dtype=np.int64).reshape(-1, 6)]
    while stack:
        pairs = stack.pop()
        if len(pairs) > PAIRS:
            stack.append(pairs[PAIRS:])
            pairs = pairs[:PAIRS]
        pairs = pairs[~forest.joined(*pairs.T[:4])]
        a0, a1, b0, b1, depth, diff = pairs.T
        # Small nodes: compare their fingerprints one by one.
        small = (a1 - a0) * (b1 - b0) <= 16
        if small.any():
            x0, x1, y0, y1 = (v[small] for v in (a0, a1, b0, b1))
            across = (x1 - x0) * (y1 - y0)
            of = np.repeat(np.arange(len(x0)), across)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(across) - across, across)
            i, j = x0[of] + nth // (y1 - y0)[of], y0[of] + nth % (y1 - y0)[of]
            i, j = i[i < j], j[i < j]
            fits = linked(i, j)
            if fits.any():
                forest.link(i[fits], j[fits])
        a0, a1, b0, b1, depth, diff = (v[~small] for v in (a0, a1, b0, b1, depth, diff))
        if not len(a0):
            continue
        am, bm = _middle(keys, a0, a1, depth), _middle(keys, b0, b1, depth)
        own, below, differs = a0 == b0, np.minimum(depth + 1, BITS), (depth < BITS).astype(np.int64)
        kids = []
        for x0, x1, y0, y1, step, which in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, differs, None), (am, a1, b0, bm, differs, own)):
            keep = (x1 > x0) & (y1 > y0) & (diff + step <= allowed[below])
            if which is not None:
                keep &= ~which
            kids.append(np.stack([x0, x1, y0, y1, below, diff + step], axis=1)[keep])
        stack.append(np.concatenate(kids))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the keys with bit ``depth`` set begin, in ranges that agree above it; the middle position below the last bit."""
    half, equal = (lo + hi) // 2, depth >= BITS
    lo, hi, bit = lo.copy(), hi.copy(), np.uint64(1) << (BITS - 1 - np.minimum(depth, BITS - 1)).astype(np.uint64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (keys[np.minimum(mid, len(keys) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return np.where(equal, half, lo)


def _rotate(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(BITS - by))


def _walk(batches, budget: int, depths: list[int], apart: int | None, direct: bool = False):
    """Columns turn, node, mask, pair, side, id, key, further words; sorted by the first four. Whole groups are walked, many at once."""
    turns = rotations(budget)
    held: list[np.ndarray] = []

    def links_of(rows: np.ndarray):
        for turn in np.unique(rows[:, 0]).tolist():
            own = rows[rows[:, 0] == turn]
            keys = own[:, 6].copy().view(np.uint64)
            at = np.lexsort((keys, own[:, 4], own[:, 3], own[:, 2], own[:, 1]))
            own, keys = own[at], keys[at]
            more = own[:, 7:].copy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, (own[1:, 1:4] != own[:-1, 1:4]).any(axis=1), True])
            second, depth = np.add.reduceat(own[:, 4], starts[:-1]).tolist(), depths[turn]
            heads = []
            for a, b, n in zip(starts[:-1].tolist(), starts[1:].tolist(), second):
                between = int(own[a, 2]).bit_count()
                if n == 0 and not between and b - a > 1:
                    heads.append((a, b, a, b, depth, 0))
                elif 0 < n < b - a:
                    heads.append((a, b - n, b - n, b, depth, between))

            def linked(i, j):
                bits = np.bitwise_count(keys[i] ^ keys[j]).astype(np.int64)
                fits = bits <= budget
                return fits if apart is None else fits & (bits + np.bitwise_count(more[i] ^ more[j]).sum(axis=1, dtype=np.int64) <= apart)

            forest = _Forest(len(keys))
            _join(keys, heads, depth_budget(budget, turns[turn][1]), linked, forest)
            if direct:
                a, b = np.concatenate(forest.links).T
            else:
                a = np.flatnonzero(forest.parent != np.arange(len(keys)))
                b = forest.parent[a]
            yield pa.RecordBatch.from_arrays([pa.array(own[a, 5]), pa.array(own[b, 5])], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1))
        if sum(map(len, held)) >= HASHES:
            rows = np.concatenate(held)
            inside = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            whole = int(inside[-1]) + 1 if len(inside) else 0
            if whole:
                yield from links_of(rows[:whole])
            held = [rows[whole:]]
    if held and sum(map(len, held)):
        yield from links_of(np.concatenate(held))


def links(distinct: DataFrame, shelf: Shelf, budget: int = 4, most: int = 1 << 15, similarity: float | None = None, direct: bool = False) -> DataFrame:
    """(a, b): of all pairs of ids whose fingerprints link, a spanning forest per task, of roots and members or (direct) of pairs that link. distinct: id, fp, further words; stored."""
    turns, names = rotations(budget), _words(SKETCH if similarity else 0)
    deeper = max(1, distinct.count() // most).bit_length() - 1
    depths = [min(BITS, max(widths[0], deeper)) for _, widths in turns]
    apart = bits_apart(similarity, BITS * len(names)) if similarity else None

    def placed_rows(batches):
        for batch in batches:
            fp = batch.column(1).to_numpy().view(np.uint64)
            for turn, (by, widths) in enumerate(turns):
                keys = _rotate(fp, by)
                top = (keys >> np.uint64(BITS - depths[turn])).astype(np.int64)
                for mask in masks(depth_budget(budget, widths), depths[turn]):
                    node = np.minimum(top, top ^ mask)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), turn, np.int32)), pa.array(node), pa.array(np.full(len(keys), mask, np.int64)), pa.array((top > node).astype(np.int32)),
                         batch.column(0), pa.array(keys.view(np.int64)), *batch.columns[2:]], names=["turn", "node", "mask", "side", "id", "key", *names[1:]])

    further = "".join(f", {n} bigint" for n in names[1:])
    placed = distinct.select("id", *names).mapInArrow(placed_rows, f"turn int, node bigint, mask bigint, side int, id bigint, key bigint{further}")
    large = shelf.put(placed.groupBy("turn", "node", "mask").count().filter(F.col("count") > 4 * most).select(
        "turn", "node", "mask", F.ceil(F.col("count") / (2 * most)).alias("blocks")), "large")
    if large.isEmpty():
        work = placed.withColumn("pair", F.lit(0).cast("bigint"))
    else:
        cut = placed.join(large, ["turn", "node", "mask"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
            "own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        # A node with itself: unordered pairs of blocks. Two nodes: every block of the one with every block of the other.
        alone = F.col("mask") == 0
        first = F.when(alone, F.least("own", "other")).otherwise(F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")))
        last = F.when(alone, F.greatest("own", "other")).otherwise(F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
        work = cut.withColumn("pair", first * F.col("blocks") + last).withColumn("side", F.when(alone, (F.col("own") > F.col("other")).cast("int")).otherwise(F.col("side")))
    dealt = work.select("turn", "node", "mask", "pair", "side", "id", "key", *names[1:]).repartition("turn", "node", "mask", "pair")
    return dealt.sortWithinPartitions("turn", "node", "mask", "pair").mapInArrow(lambda batches: _walk(batches, budget, depths, apart, direct), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, most: int = 1 << 15, similarity: float | None = None) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links).

    most: fingerprints that a subtree should hold; larger ones are cut. similarity: links are exact Jaccard similarities of this or more, whatever the
    budget; None links by the budget.
    """
    shelf = Shelf(docs.sparkSession, "simhash")
    if similarity is None:
        marked = shelf.put(fingerprints(docs, shingle), "fingerprints")
        distinct = shelf.put(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("id", F.monotonically_increasing_id()), "distinct")
        roots = components(shelf.put(links(distinct, shelf, budget, most), "links"), shelf)
        named = distinct.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
        of = shelf.put(named.join(least, "root").select("fp", "component_id"), "classes")
    else:
        rows, of = similar_groups(docs.select("doc_id", "text"), shingle, similarity, shelf)
        least = of.groupBy("root").agg(F.min("least.doc_id").alias("component_id"))
        of = of.join(least, "root").select("digest", "component_id")
        marked = rows.select("doc_id", "digest", "fp")
    return marked.join(of, of.columns[0]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, shingle: int, similarity: float, shelf: Shelf, budget: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their class (digest) and a number of their own (row), and per class its component (root) and least row.

    The fingerprints are made where the texts are read, so no text is shuffled for them. The trie join of the fingerprints proposes first; its pairs link if
    the sets have the similarity. What lies beyond the budget of bits is then looked for by least hashes.

    The least row is that of the smallest doc_id, rows without one last, then that of the smallest number.
    """
    marked = shelf.put(jaccard.marked(docs, shingle, lambda text: fingerprint(text, shingle)[0]).withColumn("row", F.monotonically_increasing_id()), "marks")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    distinct = shelf.put(marked.groupBy("digest").agg(F.min("row").alias("id"), F.min(rank).alias("least"), F.min_by("fp", "row").alias("fp")), "distinct")
    joined = shelf.put(links(distinct.select("id", "fp"), shelf, budget, direct=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "joined")
    own = Shelf(docs.sparkSession, "jaccard")
    roots = jaccard.roots(marked.withColumnRenamed("row", "id"), distinct.select("id"), own, shingle, similarity, joined)
    classes = shelf.put(distinct.join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("root"), "least"), "classes")
    own.drop("")  # what the trials stored; the rows themselves are read on
    return marked, classes


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group, that with the smallest doc_id: rows without an id come last, rows of one id by their order in the table.

    Every row is compared by its text, whatever its id, so unlike texts of one id stay, one row of each group.
    """
    shelf = Shelf(docs.sparkSession, "simhash")
    rows, of = similar_groups(docs.select(*DOCUMENT_COLUMNS), shingle, similarity, shelf)
    first = of.join(of.groupBy("root").agg(F.min("least").alias("first")), "root").select("digest", F.col("first.row").alias("first"))
    gone = shelf.put(rows.select("row", "digest").join(first, "digest").filter("row <> first").select("row"), "gone")  # mostly fewer than what stays
    return rows.join(small(gone), "row", "left_anti").withColumn("text", F.col("text").cast("string")).select(*DOCUMENT_COLUMNS)
