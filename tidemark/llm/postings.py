"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Terms are runs of ASCII digits, letters (A-Z lower-cased) and characters beyond ASCII. The index has a posting (term, row, pos) for every
term of every document. It is dealt by document: a task sorts the postings of its own documents by the terms' 64-bit hash, so no
posting is shuffled, and a search reads only the row groups that may hold its terms. Beside it lie the terms' frequencies.

A phrase is found by intersecting offset-adjusted lists from its rarest term: the postings of the rarest term, moved back by its offset, are
the candidate starts; those which the second rarest, moved back by its own offset, does not have as well are dropped; what is left must
be in the lists of all other terms. The equalities are on (term, row, position), so a frequent term or a long document makes no
hot key. ``proximity_matches`` finds all terms of a query, in any order, within a span of words around its rarest term.

Nulls and edges: a null or empty text has no terms; an item of fewer terms than a window, but not none, is one phrase; repeated
phrases are searched once and reported for every item; equal rows are documents of their own; an item without id marks words but is
neither counted nor listed; empty tables give no matches. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Shelf, small

#: What lies between terms.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: str | Column) -> Column:
    """The runs between gaps. Cutting there takes a seventh of the time of matching the runs one by one."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, GAP), "")


@dataclass
class Index:
    """postings: h, term, row, pos (from 1); documents: row, doc_id, n_words; dictionary: term, n. All are stored."""

    postings: DataFrame
    documents: DataFrame
    dictionary: DataFrame


def build_index(docs: DataFrame, shelf: Shelf) -> Index:
    """docs: doc_id, text. The empty term of a document is its own entry: its position is the number of words."""
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", terms("text").alias("words"))
    words = words.select("row", "doc_id", F.size("words").alias("n_words"), F.concat(F.array(F.lit("")), "words").alias("words"))
    posted = words.select("row", "doc_id", "n_words", F.posexplode("words").alias("pos", "term")).select(
        F.xxhash64("term").alias("h"), "term", "row", F.when(F.col("pos") == 0, F.col("n_words")).otherwise(F.col("pos")).alias("pos"),
        F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"))
    stored = shelf.put(posted.sortWithinPartitions("h"), "postings")
    own = (F.col("h") == F.xxhash64(F.lit(""))) & (F.col("term") == "")
    postings = stored.filter(~own).select("h", "term", "row", "pos")
    dictionary = shelf.put(postings.groupBy("h", "term").agg(F.count(F.lit(1)).alias("n")).select("term", "n"), "dictionary")
    return Index(postings, stored.filter(own).select("row", "doc_id", F.col("pos").cast("bigint").alias("n_words")), dictionary)


def phrases(items: DataFrame, window: int, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (w, words) and the items (w, item_id) that hold them. items: item_id, text."""
    listed = items.select("item_id", terms("text").alias("all")).filter(F.size("all") > 0).withColumn("len", F.least(F.size("all"), F.lit(window)))
    cut = shelf.put(listed.select("item_id", F.explode(F.sequence(F.lit(1), F.size("all") - F.col("len") + 1)).alias("at"), "all", "len").select(
        "item_id", F.slice("all", F.col("at"), F.col("len")).alias("words")), "cut")
    distinct = shelf.put(cut.select("words").distinct().withColumn("w", F.monotonically_increasing_id()), "phrases")
    return distinct, shelf.put(cut.join(distinct, "words").select("w", "item_id").distinct(), "holders")


def by_rarity(queries: DataFrame, index: Index, shelf: Shelf, label: str) -> DataFrame:
    """(w, off, h, term, n, rank) of the queries (w, words) whose terms all occur; rank 1 is the rarest term."""
    told = queries.select("w", F.posexplode("words").alias("off", "term")).join(index.dictionary, "term", "left")
    own = Window.partitionBy("w")
    ranked = told.withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(own)).filter("least > 0").withColumn(
        "rank", F.row_number().over(own.orderBy("n", "off")))
    return shelf.put(ranked.select("w", "off", F.xxhash64("term").alias("h"), "term", "n", "rank"), label)


def of_terms(index: Index, listed: DataFrame) -> DataFrame:
    """The postings of the terms listed."""
    return index.postings.join(small(listed.select("h", "term").distinct()), ["h", "term"], "left_semi")


def phrase_matches(index: Index, queries: DataFrame, shelf: Shelf) -> DataFrame:
    """(w, row, start, words): every place, from 1, where a query's words follow each other. queries: w, words."""
    ranked = by_rarity(queries, index, shelf, "ranked")
    first, second, rest = (ranked.filter(f"rank {of}") for of in ("= 1", "= 2", "> 2"))
    starts = index.postings.join(small(first.select("w", "off", "h", "term")), ["h", "term"]).select("w", "row", (F.col("pos") - F.col("off")).alias("start")).filter("start > 0")
    starts = shelf.put(starts, "starts-1")
    place = ["h", "term", "row", "pos"]

    def wanted(found: DataFrame, by: DataFrame) -> DataFrame:
        return found.join(by, "w").select("w", "row", "start", "h", "term", (F.col("start") + F.col("off")).alias("pos"))

    lengths = queries.select("w", F.size("words").alias("words"))
    both = starts.join(lengths, "w")
    met = wanted(starts, second).join(of_terms(index, second), place).select("w", "row", "start").join(lengths, "w")
    both = shelf.put(both.filter("words = 1").unionByName(met), "starts-2")
    open_ = both.filter("words > 2")
    near = of_terms(index, rest).join(small(shelf.put(open_.select("row").distinct(), "open-rows")), "row", "left_semi")
    met = wanted(open_, rest).join(near, place).groupBy("w", "row", "start").agg(F.count(F.lit(1)).alias("met")).join(lengths, "w").filter(
        "met = words - 2")
    return both.filter("words <= 2").unionByName(met.select("w", "row", "start", "words"))


def proximity_matches(index: Index, queries: DataFrame, span: int, shelf: Shelf) -> DataFrame:
    """(w, row, start, end): the shortest stretches (ties: the first) of at most ``span`` words which hold every term of a query in any order.

    One stretch around each place of the query's rarest term; start and end are positions from 1. queries: w, words (repeats count once).
    """
    ranked = by_rarity(queries.select("w", F.array_distinct("words").alias("words")), index, shelf, "ranked-near")
    first, rest = ranked.filter("rank = 1"), ranked.filter("rank > 1")
    at = shelf.put(index.postings.join(small(first.select("w", "h", "term", "rank")), ["h", "term"]).select("w", "row", F.col("pos").alias("p"), "rank"), "anchors")
    others = at.drop("rank").withColumn("block", F.explode(F.sequence(F.floor((F.col("p") - span + 1) / span), F.floor((F.col("p") + span - 1) / span)))).join(
        rest.select("w", "h", "term", "rank"), "w")
    near = of_terms(index, rest).withColumn("block", F.floor(F.col("pos") / span))
    found = others.join(near, ["h", "term", "row", "block"]).filter(F.abs(F.col("pos") - F.col("p")) < span).select("w", "row", "p", "pos", "rank")
    seen = found.unionByName(at.select("w", "row", "p", F.col("p").alias("pos"), "rank")).groupBy("w", "row", "p").agg(
        F.sort_array(F.collect_set(F.struct("pos", "rank"))).alias("near"))
    seen = seen.join(ranked.groupBy("w").agg(F.max("rank").alias("terms")), "w").filter(
        F.size(F.array_distinct(F.transform("near", lambda x: x["rank"]))) == F.col("terms"))

    def stretch(s):
        ends = F.transform(F.sequence(F.lit(1), F.col("terms")), lambda t: F.array_min(F.transform(
            F.filter("near", lambda x: (x["rank"] == t) & (x["pos"] >= s["pos"])), lambda x: x["pos"])))
        end = F.when(F.forall(ends, lambda e: e.isNotNull()), F.array_max(ends))
        return F.struct((end - s["pos"] + 1).alias("size"), s["pos"].alias("start"), end.alias("end"))

    whole = F.filter(F.transform(F.filter("near", lambda x: x["pos"] <= F.col("p")), stretch),
                     lambda x: x["end"].isNotNull() & (x["end"] >= F.col("p")) & (x["size"] <= span))
    return seen.withColumn("best", F.array_min(whole)).filter("best IS NOT NULL").select("w", "row", "best.start", "best.end").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a phrase's occurrence), item_ids (those with an occurring phrase, as sorted strings)."""
    shelf = Shelf(docs.sparkSession, "postings")
    index = build_index(docs, shelf)
    queries, holders = phrases(items, window, shelf)
    matches = shelf.put(phrase_matches(index, queries, shelf), "matches")
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = matches.select("row", "start", (F.col("start") + F.col("words")).alias("end")).distinct().withColumn(
        "done", F.max("end").over(before)).groupBy("row").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("done", F.lit(0))))).alias("n_hit"))
    named = matches.select("row", "w").distinct().join(holders.filter("item_id IS NOT NULL"), "w").groupBy("row").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return index.documents.join(covered, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
