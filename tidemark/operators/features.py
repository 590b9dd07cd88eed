"""The 18 statistics per segment.

Segments up to ``block`` points: one shuffle by segment, moments as plain aggregates, order-dependent features by
an Arrow kernel over the sorted arrays of a whole batch. Longer segments are never gathered: their points are
numbered, copied into overlapping blocks, summarised block by block and folded. Which of the two is needed
is known from one count per segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import series as S
from tidemark.operators.ordering import largest_group, positions
from tidemark.schema import FEATURES

BLOCK = 65_536
KERNEL_TYPE = ("n_peaks long, smooth10_n_peaks long, smooth20_n_peaks long, diff_peaks long, diff2_peaks long, "
               "diff_var double, diff2_var double, gaps_squared double")
KERNEL_FIELDS = [f.split()[0] for f in KERNEL_TYPE.split(", ")]


def _kernel(rounding: str):
    @F.pandas_udf(KERNEL_TYPE)
    def order_features(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for values, times in batches:
            yield pd.DataFrame(S.series_features(list(values), list(times), rounding))[KERNEL_FIELDS]

    return order_features


def seconds_of_day(delta: Column, rounding: str = "floor") -> Column:
    """Seconds component of a duration: days are dropped."""
    whole = F.floor(delta) if rounding == "floor" else F.bround(delta)
    return F.pmod(whole.cast("double"), F.lit(86400.0))


def _meta(points: DataFrame) -> list[Column]:
    at = F.struct("timestamp", "seq")
    return [F.min_by(c, at).alias(c) for c in ("sampling", "anomaly", "train") if c in points.columns]


def moments(points: DataFrame, keys: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Length, mean, population variance and deviation, excess kurtosis, skew, time span."""
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("len"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
        F.stddev_pop("value").alias("std"), F.kurtosis("value").alias("kurtosis"),
        F.skewness("value").alias("skew"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        *_meta(points), *(extra or []))


def derived(stats: DataFrame, rounding: str = "floor", guard: bool = True) -> DataFrame:
    """Duration and the three ratios; statistics of segments with fewer than three points are missing."""
    span = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / F.lit(1e6)
    known = F.col("len") > 2
    hidden = [c for c in FEATURES if c in stats.columns and c not in ("len", "duration", "gaps_squared", "len_weighted")]
    out = stats.withColumn("duration", seconds_of_day(span, rounding))
    for c in hidden:
        out = out.withColumn(c, F.when(known, F.col(c)))
    sampling = F.col("sampling").cast("double") if "sampling" in stats.columns else F.lit(1.0)
    ratio = F.col("var") / F.col("duration")
    flat = F.lit(0.0) if guard else F.lit(None).cast("double")
    return (
        out.withColumn("len_weighted", F.when(known, sampling * F.col("len")))
        .withColumn("var_div_duration", F.when(F.col("duration") > 0, ratio).otherwise(flat))
        .withColumn("var_div_len", F.when(known, F.col("var") / F.col("len")))
    )


def _short(points: DataFrame, keys: list[str], rounding: str) -> DataFrame:
    row = F.struct("timestamp", "seq", "value")
    # collecting does not shrink the data, so rows are dealt out by segment first and aggregated once, after the shuffle
    dealt = points.repartition(*[F.col(k) for k in keys])
    stats = moments(dealt, keys, [F.sort_array(F.collect_list(row)).alias("_rows")])
    times = F.transform("_rows", lambda r: F.unix_micros(r["timestamp"]))
    return (
        stats.withColumn("_k", _kernel(rounding)(F.col("_rows.value"), times))
        .select("*", *[F.col(f"_k.{c}").alias(c) for c in KERNEL_FIELDS])
        .drop("_rows", "_k")
    )


def _extents(rounding: str, block: int):
    """Per block: range, count, mean and squared spread of every derived series, and its share of the gap sum."""
    fields = ["gaps"] + [f"{n}_{k}" for n in S.SERIES for k in ("n", "lo", "hi", "m", "s")]
    kind = ", ".join(f"{f} {'long' if f.endswith('_n') else 'double'}" for f in fields)

    @F.pandas_udf(kind)
    def extents(values: pd.Series, times: pd.Series, first: pd.Series, home: pd.Series, total: pd.Series) -> pd.DataFrame:
        rows = []
        for x, clock, at, b, n in zip(values, times, first, home, total):
            begin, end = b * block, min(b * block + block, n)
            pos = np.arange(at, at + len(x))
            gaps = S.seconds_part(np.diff(clock) / 1e6, rounding) ** 2
            row = [float(gaps[(pos[1:] >= begin) & (pos[1:] < end)].sum())]
            for series in S.block_series(x, at, begin, end, n).values():
                body = series[1:]
                if len(body):
                    row += [len(body), body.min(), body.max(), body.mean(), ((body - body.mean()) ** 2).sum()]
                else:
                    row += [0, None, None, 0.0, 0.0]
            rows.append(row)
        return pd.DataFrame(rows, columns=fields)

    return extents


SUMMARY_TYPE = "kind: string, low: double, high: double, ties: long, inner: long, rising: boolean, at: double, at_ties: long"


def _summaries(block: int):
    @F.pandas_udf(f"array<struct<series: string, {SUMMARY_TYPE}>>")
    def summaries(values: pd.Series, first: pd.Series, home: pd.Series, total: pd.Series, needs: pd.Series) -> pd.Series:
        out = []
        for x, at, b, n, need in zip(values, first, home, total, needs):
            parts = S.block_series(x, at, b * block, min(b * block + block, n), n)
            out.append([{"series": name, **S.summarise(part, need[i])} for i, (name, part) in enumerate(parts.items())])
        return pd.Series(out)

    return summaries


@F.pandas_udf(T.LongType())
def _folded(summaries: pd.Series, need: pd.Series) -> pd.Series:
    return pd.Series([S.fold(s, n) for s, n in zip(summaries, need)])


def _long(points: DataFrame, keys: list[str], rounding: str, block: int) -> DataFrame:
    stats = moments(points, keys)
    placed = positions(points.select(*keys, "timestamp", "seq", "value"), keys, ["timestamp", "seq"])
    home = F.floor(F.col("pos") / block)
    inside = F.col("pos") % block
    copies = F.array_compact(F.array(
        home,
        F.when((inside < S.HALO) & (home > 0), home - 1),
        F.when((inside >= block - S.HALO) & ((home + 1) * block < F.col("total")), home + 1)))
    row = F.struct("pos", "value", F.unix_micros("timestamp").alias("clock"))
    packed = placed.withColumn("block", F.explode(copies)).groupBy(*keys, "block").agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list(row)).alias("rows"))
    first = F.col("rows")[0]["pos"]
    per_block = packed.withColumn(
        "e", _extents(rounding, block)("rows.value", "rows.clock", first, "block", "total")).select(*keys, "block", "e.*")
    ranges = per_block.groupBy(*keys).agg(
        F.sum("gaps").alias("gaps_squared"),
        *[(F.lit(0.1) * (F.max(f"{n}_hi") - F.min(f"{n}_lo"))).alias(f"{n}_need") for n in S.SERIES],
        *[(F.sum(F.col(f"{n}_m") * F.col(f"{n}_n")) / F.sum(f"{n}_n")).alias(f"{n}_mean") for n in ("diff", "diff2")])
    spread = per_block.join(ranges.select(*keys, "diff_mean", "diff2_mean"), keys).groupBy(*keys).agg(*[
        (F.sum(F.col(f"{n}_s") + F.col(f"{n}_n") * F.pow(F.col(f"{n}_m") - F.col(f"{n}_mean"), 2))
         / F.sum(f"{n}_n")).alias(f"{n}_var") for n in ("diff", "diff2")])
    needs = ranges.select(*keys, F.array(*[f"{n}_need" for n in S.SERIES]).alias("needs"))
    parts = packed.join(needs, keys).withColumn(
        "s", F.explode(_summaries(block)("rows.value", first, "block", "total", "needs"))).select(
        *keys, "block", "needs", "s.*")
    which = F.array_position(F.array(*[F.lit(n) for n in S.SERIES]), F.col("series")).cast("int") - 1
    entry = F.struct("block", "kind", "low", "high", "ties", "inner", "rising", "at", "at_ties")
    counts = parts.groupBy(*keys, "series").agg(
        F.sort_array(F.collect_list(entry)).alias("chain"), F.first("needs").alias("needs")).withColumn(
        "peaks", _folded("chain", F.get("needs", which)))
    names = {"raw": "n_peaks", "smooth10": "smooth10_n_peaks", "smooth20": "smooth20_n_peaks",
             "diff": "diff_peaks", "diff2": "diff2_peaks"}
    wide = counts.groupBy(*keys).agg(*[
        F.max(F.when(F.col("series") == old, F.col("peaks"))).alias(new) for old, new in names.items()])
    return (stats.join(wide, keys).join(spread, keys)
            .join(ranges.select(*keys, "gaps_squared"), keys).select(*stats.columns, *KERNEL_FIELDS))


def segment_features(points: DataFrame, keys: list[str] | None = None, rounding: str = "floor",
                     guard: bool = True, block: int = BLOCK, longest: int | None = None) -> DataFrame:
    """Meta columns and the 18 features, one row per segment. ``longest``: known bound on points per segment."""
    keys = keys or ["channel", "segment"]
    # A point without a number is no point, on either route below.
    points = points.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    if longest is None:
        longest = largest_group(points, keys)
    if longest <= block:
        stats = _short(points, keys, rounding)
    else:
        sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        big = sizes.filter(F.col("_n") > block).select(*keys)
        stats = _short(points.join(big, keys, "left_anti"), keys, rounding).unionByName(
            _long(points.join(big, keys, "left_semi"), keys, rounding, block))
    full = derived(stats, rounding, guard)
    front = keys + [c for c in ("anomaly", "train", "sampling") if c in full.columns]
    return full.select(*front, "first_ts", "last_ts", *FEATURES)


def feature_vector(columns: list[str] | None = None) -> Column:
    """Ordered array of the features, missing values as 0."""
    return F.array(*[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns or FEATURES])


def with_steps(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the gap to the one before (``_gap``) and the first and second differences (``_d1``, ``_d2``), by window functions only."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy("timestamp", "seq")
    gap = (F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(w))) / F.lit(1e6)
    return (
        points.withColumn("_gap", gap)
        .withColumn("_d1", F.col("value") - F.lag("value").over(w))
        .withColumn("_d2", F.col("_d1") - F.lag("_d1").over(w))
    )


def step_features() -> list[Column]:
    """gaps_squared, diff_var and diff2_var as aggregates over ``with_steps``."""
    return [F.coalesce(F.sum(F.pow(seconds_of_day(F.col("_gap")), 2)), F.lit(0.0)).alias("gaps_squared"),
            F.var_pop("_d1").alias("diff_var"), F.var_pop("_d2").alias("diff2_var")]


def window_features(points: DataFrame, keys: list[str]) -> DataFrame:
    """gaps_squared, diff_var and diff2_var by window functions only; for bounded segments and as a cross-check."""
    return with_steps(points, keys).groupBy(*keys).agg(*step_features())


# Features kept in a summary, and the limits of the shape classes.
SUMMARY_KEYS = ["n_peaks", "smooth10_n_peaks", "kurtosis", "skew", "diff_peaks", "diff2_peaks", "std", "var", "len"]
SPIKES_MIN_PEAKS = 3
SPIKES_MAX_DIFF_PEAKS = 2
JITTER_MIN_DIFF_PEAKS = 10
LOW_ACTIVITY_MAX_PEAKS = 1
LOW_ACTIVITY_MAX_DIFF2_PEAKS = 5


def feature_summary(keys: list[str] | None = None) -> Column:
    """Map of the key features; missing ones are left out."""
    keys = keys or SUMMARY_KEYS
    pairs = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(k).cast("double") for k in keys]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & ~F.isnan(v))


def shape_class() -> Column:
    """Shape of a segment; the first matching class wins, missing counts mean the last class."""
    peaks, diff, diff2 = F.col("n_peaks"), F.col("diff_peaks"), F.col("diff2_peaks")
    return (
        F.when(peaks.isNull() | diff.isNull() | diff2.isNull(), "unusual_shapes")
        .when((peaks >= SPIKES_MIN_PEAKS) & (diff <= SPIKES_MAX_DIFF_PEAKS), "intermittent_spikes")
        .when(diff >= JITTER_MIN_DIFF_PEAKS, "high_freq_jitter")
        .when((peaks <= LOW_ACTIVITY_MAX_PEAKS) & (diff2 <= LOW_ACTIVITY_MAX_DIFF2_PEAKS), "low_activity")
        .otherwise("unusual_shapes")
    )


def shape_enrichment(features: DataFrame, split: str = "split") -> DataFrame:
    """Anomaly rate of each shape class over the rate of its split."""
    classes = features.withColumn("shape", shape_class()).groupBy(split, "shape").agg(
        F.count(F.lit(1)).alias("n"), F.sum("anomaly").alias("positives"))
    base = classes.groupBy(split).agg((F.sum("positives") / F.sum("n")).alias("base"))
    rate = F.col("positives") / F.col("n")
    return classes.join(base, split).select(
        split, "shape", "n", rate.alias("rate"), F.when(F.col("base") > 0, rate / F.col("base")).alias("enrichment"))


def compare_features(left: DataFrame, right: DataFrame, key: str = "segment", columns: list[str] | None = None,
                     sample: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Per feature: compared values, largest absolute difference, differences above the tolerance.

    ``sample`` is the validation sample: the segments with the smallest hash among those in both tables.
    """
    from tidemark.functions.hashing import uniform

    columns = columns or FEATURES
    common = left.select(key).join(right.select(key), key, "left_semi")
    if sample is not None:
        common = common.orderBy(uniform(F.col(key), 42), key).limit(sample)
    def tall(df: DataFrame, name: str) -> DataFrame:
        return df.join(common, key, "left_semi").select(key, *[F.col(c).cast("double") for c in columns]).unpivot(
            key, columns, "feature", name)
    gap = F.abs(F.col("a") - F.col("b"))
    return tall(left, "a").join(tall(right, "b"), [key, "feature"]).groupBy("feature").agg(
        F.count(gap).alias("compared"), F.max(gap).alias("max_diff"), F.count_if(gap > tolerance).alias("mismatches"))
