"""Best-fit packing of tokenized documents into sequences, by exact complements of lengths.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` rows at any corpus size. Longest first,
a length opens sequences; the gap that it leaves is filled exactly by one, two or three lengths whose sum is the gap,
as many sequences at once as the counts of those lengths allow. Gaps without an exact filling are left to best fit: the
residual pieces go, longest first, into the sequence with the smallest gap that holds them, again in whole counts. The plan's rows
(length, ranks from and to, first sequence, offset) meet the pieces by length and rank.

Nulls and edges: a null text is an empty one and packs as its end token alone; an empty table gives no rows; repeated rows
are documents of their own; a document longer than the capacity is cut, its first piece taking the remainder. The special
token's name in a text is read as that token, as the tokenizer file has it. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shelf, running_total, slices_for
from tidemark.llm.tokens import VOCABULARY, coder

CAPACITY = 2048
def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, forget: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and its end token 0, cut to the capacity.

    forget: a worker lets go of the words that it remembers when its task ends, for jobs whose other stages need the memory.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches):
        code = coder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = code.ids(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                edges = [0, *range(first, n + 1, capacity)]
                rows += [(doc_id, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()),
                 *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if forget:
            code.known.clear()

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, offset): rank first + i lies in sequence first + i at the offset.

    Works on counts of equal lengths, so its size depends on the number of lengths, not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    shapes: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...]) -> None:
        """As many sequences of these lengths as there are pieces for."""
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        times = min(left[p] // k for p, k in need.items())
        shapes.append((parts, times))
        for p, k in need.items():
            left[p] -= k * times
            if not left[p]:
                del left[p]
                at = bisect_left(lengths, p)
                if lengths[at:at + 1] == [p]:
                    lengths.pop(at)

    def have(used: tuple[int, ...], *more: int) -> bool:
        return all(left.get(p, 0) >= used.count(p) + more.count(p) for p in more)

    def complement(head: int) -> tuple[int, ...] | None:
        gap, used = capacity - head, (head,)
        if gap == 0:
            return used
        if have(used, gap):
            return (head, gap)
        for a in reversed(lengths[:bisect_left(lengths, gap)]):
            if 2 * a < gap:
                break
            if have(used, a, gap - a):
                return (head, a, gap - a)
        for a in reversed(lengths[:bisect_left(lengths, gap)]):
            if 3 * a < gap:
                break
            rest = gap - a
            for b in reversed(lengths[:bisect_left(lengths, min(a, rest - 1) + 1)]):
                if 2 * b < rest:
                    break
                if have(used, a, b, rest - b):
                    return (head, a, b, rest - b)
        return None

    unfilled: list[int] = []
    while lengths:
        head = lengths[-1]
        found = complement(head)
        if found:
            take(found)
        else:
            unfilled.append(head)
            lengths.pop()

    # Best fit of what is left: open sequences are kept by their gap, in counts.
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    order: list[int] = []

    def open_(parts: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(parts)
        if gap not in gaps or not gaps[gap]:
            insort(order, gap)
        gaps[gap][parts] += times

    for n in sorted((n for n in unfilled if n in left), reverse=True):
        todo = left.pop(n)
        while todo:
            at = bisect_left(order, n)
            if at == len(order):
                each = min(todo, capacity // n)
                if each == 0:
                    raise ValueError("a piece is longer than the capacity")
                open_((n,) * each, todo // each)
                todo %= each
                continue
            gap = order[at]
            parts, times = next(iter(gaps[gap].items()))
            fit = gap // n
            used = min(times, todo // fit) if todo >= fit else 1
            each = fit if todo >= fit else todo
            gaps[gap][parts] -= used
            if not gaps[gap][parts]:
                del gaps[gap][parts]
                if not gaps[gap]:
                    order.pop(at)
            open_(parts + (n,) * each, used)
            todo -= used * each
    shapes += [(parts, times) for by in gaps.values() for parts, times in by.items()]

    rows, sequence, rank = [], 0, defaultdict(int)
    for parts, times in shapes:
        offset = 0
        for p in parts:
            rows.append((p, rank[p], times, sequence, offset))
            rank[p] += times
            offset += p
        sequence += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, forget: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. forget: as in pieces."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "pack")
    cut = shelf.put(pieces(docs, capacity, vocabulary, forget), "pieces")
    counts = dict(cut.groupBy("length").count().collect())  # at most ``capacity`` rows
    # A length's ranks are cut into as many cells as the plan has rows for it, so a piece meets a few rows, not all of its length.
    # The plan's size is bounded by the capacity, not by the corpus: some thousands of rows.
    planned: dict[int, list] = defaultdict(list)
    for row in plan(counts, capacity):
        planned[row[0]].append(row)
    width = {n: -(-counts[n] // len(of)) for n, of in planned.items()}
    rows = [(*row, width[n], cell) for n, of in planned.items() for row in of
            for cell in range(row[1] // width[n], (row[1] + row[2] - 1) // width[n] + 1)]
    made = spark.createDataFrame(rows, "_length bigint, _from bigint, _ranks bigint, _sequence bigint, offset bigint, _w bigint, _cell bigint")
    widths = spark.createDataFrame(list(width.items()), "_of bigint, _width bigint")
    hashed = F.xxhash64("doc_id", "piece")
    n = slices_for(docs, sum(counts.values()))
    ranked = running_total(cut, ["length"], F.pmod(hashed, F.lit(n)), [hashed, F.col("ids_crc32")], F.lit(1), "_rank")
    ranked = ranked.join(F.broadcast(widths), F.col("length") == F.col("_of")).withColumn("_at", (F.col("_rank") / F.col("_width")).cast("bigint"))
    met = ranked.join(F.broadcast(made), (F.col("length") == F.col("_length")) & (F.col("_at") == F.col("_cell"))
                      & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_ranks")))
    return met.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")
