"""Segments judged from a small state: online features, idle timers, commands, late points.

State per channel: the open segment's name and ``functions.online.Growing`` (its size does not depend on the segment's length), and the points that wait
for their turn, no more than ``delay`` holds. Rows that come out are told apart by ``kind``:

* ``closed``: a finished segment with its features; ``preview``: the same of a growing one;
* ``late``: a point older than the channel's newest time less ``delay``, left out of every segment;
* ``swings``: settled peak prominences for which the state has no room; a closed segment or preview with ``handed`` counts them too;
* ``dropped``: an open segment given up on command, with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.online import PEAKS, Growing
from tidemark.operators.features import derived
from tidemark.schema import FEATURES

MIN_PREFIX_POINTS = 5
STATISTICS = "len long, mean double, var double, std double, kurtosis double, skew double, gaps_squared double, diff_var double, diff2_var double, " + ", ".join(f"{p} long" for p in PEAKS)
ROWS = ("channel string, kind string, segment string, run long, official boolean, sampling int, first_clock long, last_clock long, last_value double, "
        f"{STATISTICS}, needs array<double>, handed boolean, series string, swings array<double>")
COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
FLUSH, DROP = "flush", "drop"


class _Segments(StatefulProcessor):
    """Per channel: a point of another declared id, or an undeclared point after too long a silence, closes what is open."""

    def __init__(self, preview: bool, delay: int | None, idle: int | None, rounding: str):
        self.preview, self.delay, self.idle, self.rounding = preview, delay, idle, rounding

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "segment string, official boolean, sampling int, last long, newest long, run long")
        self.state = handle.getValueState("state", "growing binary")
        self.waiting = handle.getListState("waiting", "clock long, seq long, segment string, sampling int, value double, command string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        channel, batch = key[0], pd.concat(list(rows)).drop(columns="channel")
        head, growing, out = self._read()
        if self.delay is not None:
            if head and head[4] is not None:
                late = (batch["clock"] < head[4] - self.delay) & batch["command"].isna()
                out += [{"kind": "late", "segment": s if isinstance(s, str) else None, "sampling": g, "first_clock": c, "last_clock": c, "last_value": v}
                        for s, g, c, v in batch.loc[late, ["segment", "sampling", "clock", "value"]].itertuples(index=False)]
                batch = batch[~late]
            points = batch.loc[batch["command"].isna(), "clock"]
            newest = max(filter(lambda x: x is not None, [head and head[4], int(points.max()) if len(points) else None]), default=None)
            kept = pd.DataFrame(list(self.waiting.get()), columns=["clock", "seq", "segment", "sampling", "value", "command"]) if self.waiting.exists() else batch[:0]
            batch = pd.concat([kept, batch]) if len(kept) else batch
            # A command lets all points before it go.
            told = batch.loc[batch["command"].notna(), "clock"]
            due = max([newest - self.delay if newest is not None else -1] + told.tolist())
            wait = batch["clock"] > due
            self._keep(batch[wait])
            batch = batch[~wait]
        else:
            newest = head and head[4]
        batch = batch.sort_values(["clock", "seq"], kind="stable")
        commands = np.flatnonzero(batch["command"].notna().to_numpy())
        at = 0
        for stop in [*commands.tolist(), len(batch)]:
            head, growing = self._points(channel, batch.iloc[at:stop], head, growing, out)
            if stop < len(batch) and head and head[0] is not None:
                kind = "closed" if batch["command"].iloc[stop] == FLUSH else "dropped"
                out.append(self._row(kind, head, growing))
                head, growing = (None, None, None, None, head[4], None), None
            at = stop + 1
        if self.preview and growing is not None and growing.n >= MIN_PREFIX_POINTS:
            out.append(self._row("preview", head, growing))
        head = (*(head or (None,) * 6)[:4], newest, head and head[5])
        self._write(head, growing)
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old if isinstance(old, int) else old[0])
            if growing is not None or self.waiting.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield from self._frame(channel, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A channel without input for ``idle``: what waits is worked off and the open segment closed."""
        head, growing, out = self._read()
        if self.waiting.exists():
            rest = pd.DataFrame(list(self.waiting.get()), columns=["clock", "seq", "segment", "sampling", "value", "command"]).sort_values(["clock", "seq"])
            head, growing = self._points(key[0], rest, head, growing, out)
            self.waiting.clear()
        if growing is not None:
            out.append(self._row("closed", head, growing))
        self._write((None, None, None, None, head and head[4], None), None)
        yield from self._frame(key[0], out)

    def close(self) -> None:
        pass

    def _read(self):
        head = tuple(self.head.get()) if self.head.exists() else None
        growing = Growing.load(bytes(self.state.get()[0])) if self.state.exists() else None
        return head, growing, []

    def _write(self, head: tuple, growing: Growing | None) -> None:
        self.head.update(head)
        if growing is None:
            self.state.clear()
        else:
            self.state.update((growing.dump(),))

    def _keep(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.waiting.put([(int(c), int(s), g if isinstance(g, str) else None, int(p), float(v), None)
                              for c, s, g, p, v in rows[["clock", "seq", "segment", "sampling", "value"]].itertuples(index=False)])
        else:
            self.waiting.clear()

    def _points(self, channel: str, rows: pd.DataFrame, head: tuple | None, growing: Growing | None, out: list):
        """Points in order, cut at the boundaries found over the whole batch."""
        if not len(rows):
            return head, growing
        clock, value = rows["clock"].to_numpy(np.int64), rows["value"].to_numpy(float)
        sampling = rows["sampling"].to_numpy()
        declared = rows["segment"].notna().to_numpy()
        names = rows["segment"].to_numpy(object)
        fresh = growing is None
        silence = np.diff(clock, prepend=clock[0] if fresh else head[3]) > np.maximum(3 * sampling, 5) * 1_000_000
        gap = ~declared & silence
        if fresh:
            gap[0] = not declared[0]
        # The name of what is open is told by the newest declared point or gap before.
        told = np.where(declared | gap, np.arange(len(rows)), -1)
        before = np.concatenate(([-1], np.maximum.accumulate(told)[:-1]))
        other = np.array([True if b < 0 and fresh else gap[b] or names[b] != n if b >= 0 else head[0] != n for b, n in zip(before[declared].tolist(), names[declared])], bool)
        opens = gap.copy()
        opens[declared] = other
        starts = sorted({0, *np.flatnonzero(opens).tolist()})
        for at, stop in zip(starts, [*starts[1:], len(rows)]):
            if opens[at]:
                if growing is not None:
                    out.append(self._row("closed", head, growing))
                name = names[at] if declared[at] else f"LIVE-{channel}-{clock[at]}"
                head, growing = (name, bool(declared[at]), int(sampling[at]), None, head and head[4], int(clock[at])), Growing(self.rounding)
            growing.push(value[at:stop], clock[at:stop])
            head = (*head[:3], int(clock[stop - 1]), *head[4:])
            out += [{"kind": "swings", "segment": head[0], "run": head[5], "series": s, "swings": p} for s, p in growing.spill()]
        return head, growing

    def _row(self, kind: str, head: tuple, growing: Growing) -> dict:
        return {"kind": kind, "segment": head[0], "run": head[5], "official": head[1], "sampling": head[2], "first_clock": growing.first, "last_clock": head[3],
                "last_value": float(growing.values[-1]), "handed": growing.handed, **growing.features()}

    def _frame(self, channel: str, out: list) -> Iterator[pd.DataFrame]:
        if out:
            frame = pd.DataFrame(out).reindex(columns=COLUMNS)
            frame["channel"] = channel
            for c, kind in (x.split() for x in ROWS.split(", ")):
                if kind in ("long", "int"):
                    frame[c] = frame[c].astype("Int64")
                elif kind == "boolean":
                    frame[c] = frame[c].astype("boolean")
                elif kind == "double":
                    frame[c] = frame[c].astype(float)
                else:
                    frame[c] = pd.Series([x if isinstance(x, (str, list)) else None for x in frame[c]], dtype=object)
            yield frame


def growing_segments(points: DataFrame, preview: bool = False, delay_seconds: float | None = None, idle_seconds: float | None = None,
                     rounding: str = "round") -> DataFrame:
    """Rows of ``ROWS`` from a stream of points (channel, timestamp, seq, value, sampling, segment or none, command or none).

    delay_seconds: points are put in order within this time and late ones behind it are handed out; None trusts the order of arrival across
    batches. idle_seconds: a channel silent for so long by the clock has its segment closed without further input. A row with the
    command ``flush`` closes its channel's open segment, ``drop`` gives it up. Needs the RocksDB state store.
    """
    def column(name: str, kind: str):
        return F.col(name).cast(kind) if name in points.columns else F.lit(None).cast(kind)

    rows = points.select("channel", F.unix_micros("timestamp").alias("clock"), F.coalesce(column("seq", "long"), F.lit(0)).alias("seq"), column("segment", "string").alias("segment"),
                         F.coalesce(column("sampling", "int"), F.lit(1)).alias("sampling"), column("value", "double").alias("value"), column("command", "string").alias("command"))
    rows = rows.filter("channel IS NOT NULL AND clock IS NOT NULL AND (command IS NOT NULL OR (value IS NOT NULL AND NOT isnan(value)))")
    micros = None if delay_seconds is None else round(delay_seconds * 1e6)
    idle = None if idle_seconds is None else round(idle_seconds * 1e3)
    return rows.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=_Segments(preview, micros, idle, rounding), outputStructType=ROWS, outputMode="Append",
        timeMode="None" if idle is None else "ProcessingTime")


def statistics(rows: DataFrame, swings: DataFrame | None = None, rounding: str = "round") -> DataFrame:
    """Meta columns and the 18 features of closed and growing segments; swings: all ``swings`` rows handed out so far."""
    d = rows.filter(F.col("kind").isin("closed", "preview"))
    if swings is not None:
        told = swings.select("channel", "run", "series", F.explode("swings").alias("swing"))
        needs = d.filter("handed").select("channel", "run", "kind", F.posexplode("needs").alias("k", "need")).withColumn("series", F.element_at(F.array(*map(F.lit, PEAKS)), F.col("k") + 1))
        more = needs.join(told, ["channel", "run", "series"]).filter("swing >= need").groupBy("channel", "run", "kind").agg(
            *[F.count_if(F.col("series") == p).alias(f"_{p}") for p in PEAKS])
        d = d.join(more, ["channel", "run", "kind"], "left").withColumns({p: F.col(p) + F.coalesce(f"_{p}", F.lit(0)) for p in PEAKS})
    d = d.withColumns({"first_ts": F.timestamp_micros("first_clock"), "last_ts": F.timestamp_micros("last_clock")})
    return derived(d, rounding).select("channel", "segment", "run", "official", "sampling", (F.col("kind") == "preview").alias("provisional"), "first_ts", "last_ts", "last_value", *FEATURES)
