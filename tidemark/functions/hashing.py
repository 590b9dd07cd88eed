"""Reproducible randomness: a uniform number per (key, seed), the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, seed: int | str | Column) -> Column:
    """Value in [0, 1) from the first 32 bits of md5(key#seed)."""
    tail = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat_ws("#", key.cast("string"), tail.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def set_digest(col: Column) -> Column:
    """Aggregate digest of a set of distinct values: the sums of four 32-bit parts of their md5, each cut to 32 bits, as 32 hex digits.

    It needs no order and no list of the values, and any engine with md5 can compute it.
    """
    digest = F.md5(col.cast("string"))
    parts = [F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")) % (1 << 32) for at in (1, 9, 17, 25)]
    return F.concat(*[F.lpad(F.lower(F.hex(p)), 8, "0") for p in parts])
