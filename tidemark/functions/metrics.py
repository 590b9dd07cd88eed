"""Classification metrics as expressions over (possibly weighted) confusion counts; division by zero is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL_SAMPLE = 30


def counts(y: Column, p: Column) -> list[Column]:
    """Aggregates tn, fp, fn, tp."""
    return [
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    ]


def weighted_counts(y: Column, p: Column, w: Column) -> list[Column]:
    def cell(a: int, b: int) -> Column:
        return F.sum(F.when((y == a) & (p == b), w).otherwise(0)).cast("long")
    return [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]


def _c(x: Column | None, name: str) -> Column:
    return F.col(name) if x is None else x


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def precision(tp: Column | None = None, fp: Column | None = None) -> Column:
    tp, fp = _c(tp, "tp"), _c(fp, "fp")
    return ratio(tp, tp + fp)


def recall(tp: Column | None = None, fn: Column | None = None) -> Column:
    tp, fn = _c(tp, "tp"), _c(fn, "fn")
    return ratio(tp, tp + fn)


def f1(tp: Column | None = None, fp: Column | None = None, fn: Column | None = None) -> Column:
    tp, fp, fn = _c(tp, "tp"), _c(fp, "fp"), _c(fn, "fn")
    return ratio(2.0 * tp, 2.0 * tp + fp + fn)


def accuracy() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def mcc() -> Column:
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    return ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))


def false_alarm_ratio() -> Column:
    """fp/(tp+fp); NULL when nothing was predicted."""
    flagged = F.col("tp") + F.col("fp")
    return F.when(flagged > 0, F.col("fp") / flagged)


def all_metrics() -> list[Column]:
    """Columns derived from tn, fp, fn, tp."""
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return [
        "tn", "fp", "fn", "tp", n.alias("n"), (F.col("tp") + F.col("fn")).alias("n_true"),
        (F.col("tp") + F.col("fp")).alias("n_pred"), f1().alias("f1"), precision().alias("precision"),
        recall().alias("recall"), accuracy().alias("accuracy"), mcc().alias("mcc"),
        false_alarm_ratio().alias("false_alarm_ratio"), (n < SMALL_SAMPLE).alias("small_sample"),
    ]
