"""Mixing sources to target weights by a low-discrepancy schedule.

Every source gets a share of the mix by its weight; a share above ``most`` times the source's size is cut there and the
excess is dealt to the others by weight. The mix is a row of slots of ``block`` words. Slot k takes the point
frac(k * golden ratio) on the line of cumulative targets, which names its source, so that every stretch of the schedule holds the
sources nearly in proportion. The slots of a source are ranked; rank r takes block r of the source's stream. A stream is
the source's documents in hashed order, run through again in another order for the next pass, cut into blocks of equal
words. A source whose points fall short of its target gets the missing slots at the end, so its words are its rounded target.

Nulls and edges: a null text has size 0; null is a source of its own, last by order; documents of size 0 are taken 0
times; an empty table gives an empty result; repeated rows are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import DOCUMENT_COLUMNS, WORD, Shelf, running_total, slices_for

WEIGHTS = (5.0, 2.0, 1.0)
CELLS = 4096
#: The golden ratio's fraction to 40 places, for steps that stay exact at any slot number.
GOLDEN = Fraction(6180339887498948482045868343656381177203, 10**40)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: sid, source, source_size, target, and its place [lo, hi) on the line of targets.

    Sources sorted by cap over weight: those before the first whose share stays below its cap are at their cap, and the
    rest share what is left by weight. That is where repeated resharing ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    given = given.withColumn("sid", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1)).withColumn(
        "cap", F.lit(most) * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = given.withColumn("total", F.lit(share) * F.sum("source_size").over(every)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    filled = filled.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap")).withColumn(
        "level", F.max(F.when(F.col("fits"), F.col("level"))).over(every)).withColumn(
        "target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    along = Window.orderBy("sid")
    whole = F.nullif(F.sum("target").over(every), F.lit(0.0))
    return filled.withColumn("hi", F.sum("target").over(along) / whole).withColumn(
        "lo", F.coalesce(F.lag("hi").over(along), F.lit(0.0))).select("sid", "source", "source_size", "target", "lo", "hi")


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """sid and rank of every slot of the golden-ratio schedule."""
    spark = targets.sparkSession
    step, jump = float(GOLDEN), float(GOLDEN * 2**20 % 1)
    points = spark.range(slots).withColumn(
        "point", ((F.col("id") / F.lit(2**20)).cast("bigint") * F.lit(jump) + F.col("id") % (2**20) * F.lit(step)) % 1.0)
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    # Every source lies in the cells that its stretch of the line touches, so points find it by an equality.
    spans = targets.filter("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    last = F.col("hi") >= 1.0 - 1e-12
    named = points.join(spans, "cell").filter((F.col("point") >= F.col("lo")) & ((F.col("point") < F.col("hi")) | last))
    named = named.select("sid", F.col("id").alias("slot"))
    n = slices_for(targets, slots)
    return running_total(named, ["sid"], (F.col("slot") / F.lit(max(1, -(-slots // n)))).cast("bigint"), [F.col("slot")], F.lit(1), "rank")


def _placed(docs: DataFrame, weights, share: float, most: float, block: int, slots: int, keys: list[str]) -> DataFrame:
    """Every stretch of a document in a block of its source's stream, with the block's slot; slot is null where the mix leaves it out.

    Columns: row, doc_id, source, size, source_size, target, the keys, block, slot, at and words (the stretch of the document).
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "mix")
    sizes = shelf.put(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                                  *keys, F.monotonically_increasing_id().alias("row")), "sizes")
    rows, words = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = source_targets(sizes, weights, share, most)
    b = max(1, min(block, int(share * words) // slots))
    quota = F.round("target").cast("bigint")
    targets = shelf.put(targets.withColumn("quota", quota).withColumn("ranks", -F.floor(-F.col("quota") / F.lit(b))), "targets")

    points = -(-int(share * words) // b)
    planned = schedule(targets, points)
    scheduled = planned.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    # The few blocks that a source's points lack follow the last point, the sources in turns.
    turn = targets.agg(F.count(F.lit(1))).first()[0]
    short = targets.join(scheduled, "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("ranks > n").select(
        "sid", F.explode(F.sequence(F.col("n"), F.col("ranks") - 1)).alias("rank"), "n").select(
        "sid", "rank", (F.lit(points) + (F.col("rank") - F.col("n")) * F.lit(turn) + F.col("sid") - 1).alias("slot"))
    taken_blocks = planned.select("sid", "rank", "slot").unionByName(short).join(targets.select("sid", "quota", "ranks"), "sid").filter("rank < ranks").select(
        "sid", F.col("rank").alias("block"), "slot", F.least(F.lit(b), F.col("quota") - F.col("rank") * b).alias("held"))

    named = sizes.join(targets.select("sid", F.col("source").alias("_source"), "source_size", "target", "quota"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    passes = named.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), -F.floor(-F.col("quota") / F.greatest("source_size", F.lit(1))) - 1).cast("int"))))
    n = slices_for(docs, rows)
    hashed = F.xxhash64("doc_id", "pass")
    streamed = running_total(passes, ["sid", "pass"], F.pmod(hashed, F.lit(n)), [hashed, F.col("doc_id"), F.col("size"), F.col("row")], F.col("size"), "start")
    streamed = streamed.withColumn("start", F.col("start") + F.col("pass") * F.col("source_size"))
    pieces = streamed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(
        F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)))))
    low = F.greatest(F.col("start"), F.col("block") * b)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("held"))
    return pieces.join(taken_blocks, ["sid", "block"], "left").withColumn("words", F.greatest(high - low, F.lit(0))).select(
        "row", "doc_id", "source", "size", "source_size", "target", *keys, "block", F.when(F.col("words") > 0, F.col("slot")).alias("slot"),
        (low - F.col("start")).alias("at"), "words")


def mix_rows(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 1024, slots: int = 65_536) -> DataFrame:
    """The mix: slot, source, block, doc_id, first and last word (end exclusive, from 0) of the document that stand there.

    Read by slot, and by doc_id within it, it is the interleaved corpus; a slot holds consecutive words of one source's stream.
    """
    return _placed(docs, weights, share, most, block, slots, []).filter("slot IS NOT NULL").select(
        "slot", "source", "block", "doc_id", F.col("at").alias("first"), (F.col("at") + F.col("words")).alias("last"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 1024, slots: int = 65_536,
        keys: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, first_slot, last_slot (null where nothing is taken).

    block: words in a slot, fewer when the mix would not fill ``slots`` of them. keys: further columns to carry.
    """
    keys = keys or []
    taken = F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).cast("bigint")
    return _placed(docs, weights, share, most, block, slots, keys).groupBy("row", "doc_id", "source", "size", "source_size", "target", *keys).agg(
        taken.alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")).drop("row")


def mixed_documents(docs: DataFrame, ordered: bool = True, **options) -> DataFrame:
    """The documents of the mix: as many copies as ``taken`` has of the document's size, rounded (half up).

    Only the last document of a source is taken in part, so rounding moves a source by one document at most. Identical rows share
    their words evenly. Keeps the columns of documents. The copies come in the order of the schedule: a document's copies are
    spread evenly from its first slot to its last. ordered: False spares that shuffle where the reader does not care.
    """
    plain = docs.select(*DOCUMENT_COLUMNS).withColumn("_text_key", F.xxhash64("text"))
    taken = mix(plain, keys=["_text_key"], **options).groupBy("doc_id", "source", "_text_key").agg(
        F.floor(F.sum("taken") / F.nullif(F.sum("size"), F.lit(0)) + 0.5).cast("int").alias("_copies"),
        F.min("first_slot").alias("_first"), F.max("last_slot").alias("_last")).filter("_copies > 0").select(
        *[F.col(c).alias(f"_m_{c}") for c in ("doc_id", "source", "_text_key")], "_copies", "_first", "_last")
    on = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in ("doc_id", "source", "_text_key")]
    copies = plain.join(taken, on).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    if ordered:
        step = (F.col("_last") - F.col("_first")) / F.greatest(F.col("_copies") - 1, F.lit(1))
        copies = copies.orderBy(F.col("_first") + F.col("_copy") * step, "source", "doc_id", "_text_key")
    return copies.select(*DOCUMENT_COLUMNS)
