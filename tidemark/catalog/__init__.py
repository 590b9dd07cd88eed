"""Registered queries over the driver's tables, each beside its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def entries() -> list[Entry]:
    from importlib import import_module

    found: list[Entry] = []
    for part in MODULES:
        found += import_module(f"tidemark.catalog.{part}").ENTRIES
    names = [e.name for e in found]
    assert len(names) == len(set(names)), "duplicate query name"
    return found


MODULES = ["telemetry", "judging", "retrieval", "dashboards", "streams", "models"]
