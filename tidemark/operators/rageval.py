"""How good was the retrieval, and how complete are the answers?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import found_terms


def judge_queries(results: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per labelled query. Results: ``query_id, rank, source_name, content, score[, low_confidence]``;
    specs: ``query_id, kind, expect_sources, must_terms``. Queries without results are kept."""
    if "low_confidence" not in results.columns:
        results = results.withColumn("low_confidence", F.lit(False))
    rows = results.join(specs, "query_id").withColumn("_ok", F.array_contains("expect_sources", F.col("source_name")))
    rows = rows.withColumn("_terms", found_terms(F.col("content"), F.col("must_terms")))
    usable = F.col("_ok") & (F.size("_terms") > 0)
    per = rows.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("_ok"))).alias("source_hit_at_1"), F.bool_or("_ok").alias("source_hit_at_k"),
        F.min(F.when(usable, F.col("rank"))).alias("rank_first_usable"),
        F.array_distinct(F.flatten(F.collect_list("_terms"))).alias("_found"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1_score"),
        F.max(F.when(F.col("rank") == 1, F.col("source_name"))).alias("top1_source"), F.bool_or("low_confidence").alias("low_confidence"))
    share = F.coalesce(F.size("_found"), F.lit(0)) / F.greatest(F.size("must_terms"), F.lit(1))
    return specs.join(per, "query_id", "left").select(
        "query_id", "kind", F.coalesce("source_hit_at_1", F.lit(False)).alias("source_hit_at_1"),
        F.coalesce("source_hit_at_k", F.lit(False)).alias("source_hit_at_k"), "rank_first_usable",
        F.col("rank_first_usable").isNotNull().alias("usable_at_k"),
        F.round(F.when(F.col("_found").isNull(), 0.0).otherwise(share), 4).alias("kw_recall"),
        F.coalesce("top1_score", F.lit(0.0)).alias("top1_score"), F.coalesce("top1_source", F.lit("<empty>")).alias("top1_source"),
        F.coalesce("low_confidence", F.lit(False)).alias("low_confidence"))


def summarise_queries(judged: DataFrame) -> DataFrame:
    """Averages overall (NULL kind) and by kind; the reciprocal rank averages over queries with a usable hit."""
    def share(c: str):
        return F.avg(F.col(c).cast("double")).alias(c)
    return judged.rollup("kind").agg(
        F.count(F.lit(1)).alias("n"), share("source_hit_at_1"), share("source_hit_at_k"), share("usable_at_k"),
        F.avg("kw_recall").alias("kw_recall"), F.coalesce(F.avg(1.0 / F.col("rank_first_usable")), F.lit(0.0)).alias("mrr"),
        F.avg("top1_score").alias("top1_score_mean"), F.min("top1_score").alias("top1_score_min"),
        F.avg(F.col("low_confidence").cast("double")).alias("low_conf_ratio"))


def source_share(results: DataFrame) -> DataFrame:
    counted = results.groupBy("source_name").agg(F.count(F.lit(1)).alias("slots"))
    return counted.join(F.broadcast(counted.agg(F.sum("slots").alias("_all")))).select(
        "source_name", "slots", (F.col("slots") / F.col("_all")).alias("share"))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per query what changed between two judged runs, and whether it is a regression.

    A first usable rank that gets larger, or is lost, is a regression; one that gets smaller is not.
    """
    cols = ["usable_at_k", "kw_recall", "rank_first_usable", "top1_score", "top1_source"]
    a = before.select("query_id", *[F.col(c).alias(f"before_{c}") for c in cols], F.lit(True).alias("_a"))
    b = after.select("query_id", *[F.col(c).alias(f"after_{c}") for c in cols], F.lit(True).alias("_b"))
    both = a.join(b, "query_id", "full_outer")
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}"))
    rank = lambda side: F.coalesce(F.col(f"{side}_rank_first_usable"), F.lit(99))
    worse = ((F.col("before_usable_at_k") & ~F.col("after_usable_at_k"))
             | (F.col("after_kw_recall") < F.col("before_kw_recall") - 1e-9) | (rank("after") > rank("before")))
    both_sides = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.withColumn("in_both", both_sides).withColumn("changed", changed).withColumn(
        "regression", F.coalesce(worse & both_sides, F.lit(False))).drop("_a", "_b")


def coverage(records: DataFrame, n_sources: str = "n_sources", full: int = 5) -> DataFrame:
    c = F.col(n_sources)
    return records.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c > 0).alias("n_with_sources"), F.min(c).alias("sources_min"),
        F.max(c).alias("sources_max"), F.avg(c).alias("sources_mean"), F.count_if(c >= full).alias("n_full"))


def per_channel(log: DataFrame) -> DataFrame:
    """Retrieval log (channel, top_score, n_results, retrieval_ms) by channel."""
    return log.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.avg("top_score").alias("avg_top_score"), F.avg("n_results").alias("avg_results"),
        F.avg("retrieval_ms").alias("avg_ms"))


def one_per_class(df: DataFrame, flag: str, order: str) -> DataFrame:
    """First flagged, first unflagged, and the third row overall."""
    first = df.withColumn("_r", F.row_number().over(W.partitionBy(flag).orderBy(order))).filter("_r = 1").drop("_r").withColumn(
        "example", F.when(F.col(flag), "strong").otherwise("weak"))
    third = df.orderBy(order).limit(3).orderBy(F.desc(order)).limit(1).withColumn("example", F.lit("overall"))
    return first.unionByName(third)
