"""The four severity scales and the display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FAULT = 0.05
WARN = 0.15
CRIT = 0.4


def by_score(score: Column, channel: Column, quiet: list[str] | None = None) -> Column:
    """Alert queue: by anomaly score; channels without any positive are always nominal."""
    level = F.when(score > CRIT, "critical").when(score > WARN, "warning").when(score > FAULT, "caution").otherwise("nominal")
    return F.when(channel.isin(quiet), "nominal").otherwise(level) if quiet else level


def by_rate(rate: Column, channel: Column, quiet: list[str] | None = None) -> Column:
    """Channel window: by anomaly rate, any positive rate is at least caution."""
    level = F.when(rate > CRIT, "critical").when(rate > WARN, "warning").when(rate > 0, "caution").otherwise("nominal")
    return F.when(channel.isin(quiet), "nominal").otherwise(level) if quiet else level


def by_preview(score: Column, hits: Column, tau95: Column, std: Column) -> Column:
    """Growing segment: forest score against the training tail, else hit counts (2, 3, 4)."""
    by_forest = (F.when(score > tau95 + 3.0 * std, "critical").when(score > tau95 + 1.5 * std, "warning")
                 .when(score > tau95, "caution").otherwise("nominal"))
    by_hits = F.when(hits >= 4, "critical").when(hits >= 3, "warning").when(hits >= 2, "caution").otherwise("nominal")
    return F.when(score.isNotNull(), by_forest).otherwise(by_hits)
