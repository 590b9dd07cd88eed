"""Row order inside a key whose size is unknown.

A window over ``partitionBy(channel)`` puts a whole channel into one task. Here each
key is cut into slices of time; windows run inside (key, slice), and one small row per slice
carries counts and edge values across the cuts. Results equal the plain window. When time slices
come out uneven (bursts), the rows are range-partitioned by key and order instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SLICE_ROWS = 1_000_000
BURST = 8


def _cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def slice_seconds(df: DataFrame, keys: list[str], ts: str = "timestamp", target: int = SLICE_ROWS) -> int:
    """Slice width so that the densest key has about ``target`` rows per slice.

    One aggregate with map-side combine and one row to the driver.
    """
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6).alias("span"),
    )
    row = per_key.agg(
        F.max(F.col("n") / F.greatest(F.col("span"), F.lit(1.0))).alias("density"),
        F.max("n").alias("n"),
        F.max("span").alias("span"),
    ).first()
    if row is None or row["n"] is None:
        return 86400
    if row["n"] <= target:
        return int(max(row["span"], 1.0)) + 86400
    return max(1, int(target / row["density"]))


def with_slice(df: DataFrame, seconds: int, ts: str = "timestamp") -> DataFrame:
    return df.withColumn("_slice", F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)))


def sliced(df: DataFrame, keys: list[str], order: list[str], ts: str = "timestamp", seconds: int | None = None,
           target: int = SLICE_ROWS) -> DataFrame:
    """``_slice``: a number that grows with the order inside each key and splits large keys into bounded parts."""
    if seconds is not None:
        return with_slice(df, seconds, ts)
    seconds = slice_seconds(df, keys, ts, target)
    cut = with_slice(df, seconds, ts)
    if largest_group(df, keys) <= target or largest_group(cut, [*keys, "_slice"]) <= BURST * target:
        return cut
    parts = max(2, -(-df.count() // target))
    ranged = df.repartitionByRange(parts, *_cols(keys), *_cols(order)).withColumn("_slice", F.spark_partition_id().cast("long"))
    return cut_lineage(ranged)  # range bounds are sampled: written once, so that all readers see the same cut


def _slice_offsets(df: DataFrame, keys: list[str]) -> DataFrame:
    counts = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    ordered = W.partitionBy(*keys).orderBy("_slice")
    return counts.select(
        *keys, "_slice", "_rows",
        (F.sum("_rows").over(ordered) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(W.partitionBy(*keys)).alias("_total"),
    )


def positions(df: DataFrame, keys: list[str], order: list[str], ts: str = "timestamp",
              seconds: int | None = None, pos: str = "pos", total: str = "total") -> DataFrame:
    """Exact 0-based position of every row inside its key, and the key's row count."""
    cut = sliced(df, keys, order, ts, seconds)
    local = cut.withColumn(
        "_at", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*_cols(order))))
    return (
        local.join(_slice_offsets(cut, keys), [*keys, "_slice"])
        .withColumn(pos, F.col("_before") + F.col("_at") - 1)
        .withColumnRenamed("_total", total)
        .drop("_slice", "_at", "_before", "_rows")
    )


def tail_rows(df: DataFrame, keys: list[str], order: list[str], n: int, ts: str = "timestamp",
              seconds: int | None = None) -> DataFrame:
    """Last ``n`` rows of each key with ``rank_desc``; slices that cannot hold them are dropped first."""
    cut = sliced(df, keys, order, ts, seconds)
    wanted = _slice_offsets(cut, keys).filter(
        F.col("_before") + F.col("_rows") > F.col("_total") - n).select(*keys, "_slice", "_before", "_total")
    local = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*_cols(order)))
    return (
        cut.join(wanted, [*keys, "_slice"])
        .withColumn("rank_desc", F.col("_total") - F.col("_before") - local + 1)
        .filter(F.col("rank_desc") <= n)
        .drop("_slice", "_before", "_total")
    )


def carry_forward(df: DataFrame, keys: list[str], order: list[str], col: str, out: str,
                  seconds: int | None = None, ts: str = "timestamp") -> DataFrame:
    """Last known value of ``col`` before each row of its key."""
    cut = sliced(df, keys, order, ts, seconds)
    inside = W.partitionBy(*keys, "_slice").orderBy(*_cols(order)).rowsBetween(W.unboundedPreceding, -1)
    at = F.when(F.col(col).isNotNull(), F.struct(*_cols(order)))
    across = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    edges = cut.groupBy(*keys, "_slice").agg(F.max_by(col, at).alias("_tail")).select(
        *keys, "_slice", F.last("_tail", ignorenulls=True).over(across).alias("_earlier"))
    return (
        cut.withColumn("_near", F.last(col, ignorenulls=True).over(inside))
        .join(edges, [*keys, "_slice"])
        .withColumn(out, F.coalesce("_near", "_earlier"))
        .drop("_slice", "_near", "_earlier")
    )


def run_numbers(df: DataFrame, keys: list[str], order: list[str], carry: list[str],
                starts: Callable[[Column, Column], Column], ts: str = "timestamp",
                seconds: int | None = None, out: str = "run") -> DataFrame:
    """Number runs 1, 2, ... inside each key.

    ``starts(previous, current)`` gets two structs of the ``carry`` columns and says whether the
    current row opens a run; the first row of a key always does.
    """
    here = F.struct(*_cols(carry))
    inside = W.partitionBy(*keys, "_slice").orderBy(*_cols(order))
    flagged = (
        sliced(df, keys, order, ts, seconds)
        .withColumn("_cur", here)
        .withColumn("_prev", F.lag("_cur").over(inside))
        .withColumn("_open", F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(
            starts(F.col("_prev"), F.col("_cur")).cast("int")))
    )
    at = F.struct(*_cols(order))
    edges = flagged.groupBy(*keys, "_slice").agg(
        F.sum("_open").alias("_opened"),
        F.min_by("_cur", at).alias("_first"),
        F.max_by("_cur", at).alias("_last"),
    )
    across = W.partitionBy(*keys).orderBy("_slice")
    edges = edges.withColumn("_before_cut", F.lag("_last").over(across)).withColumn(
        "_head", F.when(F.col("_before_cut").isNull(), F.lit(1)).otherwise(
            starts(F.col("_before_cut"), F.col("_first")).cast("int")))
    edges = edges.select(
        *keys, "_slice", "_before_cut",
        (F.sum(F.col("_opened") + F.col("_head")).over(across) - F.col("_opened")).alias("_base"))
    running = F.sum("_open").over(inside.rowsBetween(W.unboundedPreceding, 0))
    return (
        flagged.withColumn("_running", running)
        .join(edges, [*keys, "_slice"])
        .withColumn(out, F.col("_base") + F.col("_running"))
        .drop("_slice", "_cur", "_prev", "_open", "_running", "_base", "_before_cut")
    )


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest key: one aggregate, one number to the driver."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return int(top["n"] or 0) if top else 0
