"""Which candidates are shown: priority decides on admission, score on the order.

All per-query work is on candidate pools of bounded depth (see ``pool_depth``), so windows by query are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Results one source may take, by priority; anything else gets one.
CAPS = {0: 3, 1: 3, 2: 2, 3: 2, 4: 1, 5: 1}
REL_DELTA = 0.12
RESERVE_PRIORITY_MAX = 2
UNKNOWN_PRIORITY = 99


def cap_of(priority: Column) -> Column:
    out = F.lit(1)
    for p, n in CAPS.items():
        out = F.when(priority == p, n).otherwise(out)
    return out


def select_candidates(pool: DataFrame, top_k: int = 5, rel_delta: float = REL_DELTA, max_reserved: int | None = None,
                      reserve_priority_max: int = RESERVE_PRIORITY_MAX) -> DataFrame:
    """Reserved seats for high-priority sources near the top, then four fill passes with source caps.

    Pool: ``query_id, chunk_id, score, source_name, priority[, pool_rank]``. Returns the chosen rows with ``rank``.
    Seats go to sources by (priority, best score); the passes are: in the zone within the cap, in the zone beyond it,
    outside within, outside beyond. A cap counts everything chosen so far, which makes the passes a fold over
    the pool; it runs as an array expression.
    """
    seats = max(1, top_k // 2) if max_reserved is None else max_reserved
    q = W.partitionBy("query_id")
    rows = pool
    if "pool_rank" not in pool.columns:
        rows = rows.withColumn("pool_rank", F.row_number().over(q.orderBy(F.col("score").desc(), "chunk_id")))
    rows = rows.withColumn("_src", F.coalesce("source_name", F.lit("unknown"))).withColumn(
        "_prio", F.coalesce(F.col("priority").cast("int"), F.lit(UNKNOWN_PRIORITY)))
    rows = rows.withColumn("_zone", F.col("score") >= F.max("score").over(q) - F.lit(rel_delta))
    by_source = W.partitionBy("query_id", "_src", "_zone")
    rows = rows.withColumn("_first", F.row_number().over(by_source.orderBy(F.col("score").desc(), "pool_rank")))
    rows = rows.withColumn("_best_prio", F.min("_prio").over(by_source)).withColumn(
        "_seen", F.min("pool_rank").over(by_source))
    candidate = F.col("_zone") & (F.col("_first") == 1) & (F.col("_best_prio") <= reserve_priority_max)
    seat_order = q.orderBy(candidate.desc(), "_best_prio", F.col("score").desc(), "_seen")
    rows = rows.withColumn("_seat_no", F.row_number().over(seat_order)).withColumn(
        "_seat", candidate & (F.col("_seat_no") <= seats))
    packed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("neg"), F.col("pool_rank").alias("at"), F.col("_src").alias("src"),
        cap_of(F.col("_prio")).alias("cap"), F.col("_zone").alias("zone"), F.col("_seat").alias("seat"),
        F.col("_seat_no").alias("seat_no")))).alias("c"))
    seated = F.transform(
        F.array_sort(F.filter("c", lambda x: x["seat"]), lambda a, b: a["seat_no"] - b["seat_no"]),
        lambda x: F.struct(x["at"].alias("at"), x["src"].alias("src")))

    def fill(chosen: Column, zone: bool, capped: bool) -> Column:
        def step(acc: Column, x: Column) -> Column:
            room = (F.size(acc) < top_k) & (x["zone"] == F.lit(zone)) & ~F.exists(acc, lambda s: s["at"] == x["at"])
            if capped:
                room = room & (F.size(F.filter(acc, lambda s: s["src"] == x["src"])) < x["cap"])
            return F.when(room, F.array_append(acc, F.struct(x["at"].alias("at"), x["src"].alias("src")))).otherwise(acc)
        return F.aggregate("c", chosen, step)

    out = packed.withColumn("s", seated)
    for zone, capped in ((True, True), (True, False), (False, True), (False, False)):
        out = out.withColumn("s", fill(F.col("s"), zone, capped))
    chosen = out.select("query_id", F.posexplode(F.slice("s", 1, top_k)).alias("_pick", "_s")).select(
        "query_id", "_pick", F.col("_s.at").alias("pool_rank"))
    back = rows.join(chosen, ["query_id", "pool_rank"])
    return back.withColumn("rank", F.row_number().over(q.orderBy(F.col("score").desc(), "_pick"))).withColumn(
        "reserved", F.col("_seat")).select(*pool.columns, "rank", "reserved")


def select_in_zone(pool: DataFrame, top_k: int = 5, rel_delta: float = REL_DELTA) -> DataFrame:
    """The first two passes by windows only (no seats): in the zone within the cap, then beyond it."""
    q = W.partitionBy("query_id")
    rows = pool.withColumn("_zone", F.col("score") >= F.max("score").over(q) - F.lit(rel_delta)).filter("_zone")
    nth = F.row_number().over(W.partitionBy("query_id", "source_name").orderBy(F.col("score").desc(), "chunk_id"))
    rows = rows.withColumn("_over", (nth > cap_of(F.col("priority"))).cast("int"))
    rows = rows.withColumn("_pick", F.row_number().over(q.orderBy("_over", F.col("score").desc(), "chunk_id"))).filter(
        F.col("_pick") <= top_k)
    return rows.withColumn("rank", F.row_number().over(q.orderBy(F.col("score").desc(), "chunk_id"))).drop(
        "_zone", "_over", "_pick")


def select_diverse(pool: DataFrame, top_k: int = 5) -> DataFrame:
    """Older policy: at most max(2, k div sources + 1) per source, then the best k."""
    q = W.partitionBy("query_id")
    # over the query's window, so that the pool is not made a second time
    counted = pool.filter("query_id IS NOT NULL").withColumn("_sources", F.size(F.collect_set("source_name").over(q))).withColumn("_n", F.count(F.lit(1)).over(q))
    nth = F.row_number().over(W.partitionBy("query_id", "source_name").orderBy(F.col("score").desc(), "chunk_id"))
    cap = F.greatest(F.lit(2), F.floor(F.lit(top_k) / F.col("_sources")) + 1)
    rows = counted.withColumn("_nth", nth).filter(
        (F.col("_n") <= top_k) | (F.col("_nth") <= cap))
    return rows.withColumn("rank", F.row_number().over(q.orderBy(F.col("score").desc(), "chunk_id"))).filter(
        F.col("rank") <= top_k).drop("_nth", "_sources", "_n")
