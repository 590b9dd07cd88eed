"""NumPy kernels over many short series at once, plus block summaries for long ones.

A peak counts when both sides fall by at least ``need`` before a higher sample appears.
One pass with two states decides that: falling (remember the lowest value so far) and rising (remember
the highest value and how often it was reached). A block of a long series is reduced to a
small summary of that pass, so that blocks can be worked on apart and folded in order.
"""

from __future__ import annotations

import numpy as np

SMOOTH = (10, 20)


def count_peaks(values, need: float) -> int:
    """Peaks of one series whose prominence is at least ``need``; equal neighbours are one sample."""
    if len(values) == 0:
        return 0
    low, high, ties, found, rising = values[0], 0.0, 0, 0, False
    for v in values:
        if rising:
            if v > high:
                high, ties = v, 1
            elif v == high:
                ties += 1
            elif high - v >= need:
                found += ties
                rising, low = False, v
        elif v < low:
            low = v
        elif v - low >= need and v > low:
            rising, high, ties = True, v, 1
    return found


def flat_peaks(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Peak count per series for series laid end to end; threshold is a tenth of each range."""
    out = np.zeros(len(starts), dtype=np.int64)
    for k in np.flatnonzero(ends - starts > 2):
        x = flat[starts[k]:ends[k]]
        spread = x.max() - x.min()
        if not spread > 0:
            continue
        x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        if len(x) > 2:
            up = x[1:] > x[:-1]
            turn = np.concatenate(([True], up[1:] != up[:-1], [True]))
            x = x[turn]
        out[k] = count_peaks(x.tolist(), 0.1 * spread)
    return out


def running_means(x: np.ndarray, width: int) -> np.ndarray:
    """Mean of each sample and the ``width - 1`` before it, zeros outside. Always summed in the same order, so that equal
    windows give equal means wherever they lie."""
    out = np.zeros(len(x) + width - 1)
    for k in range(width):
        out[k:k + len(x)] += x
    return out / width


def smooth(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int):
    """Centred moving mean with zero padding; a series shorter than ``width`` yields ``width`` values."""
    n = ends - starts
    room = n + width
    at = np.concatenate(([0], np.cumsum(room)[:-1])).astype(np.int64)
    padded = np.zeros(int(room.sum()) if len(room) else 0)
    for s, e, a in zip(starts, ends, at):
        padded[a:a + e - s] = flat[s:e]
    full = running_means(padded, width) if len(padded) else padded
    begin = at + (np.minimum(n, width) - 1) // 2
    return full, begin, begin + np.maximum(n, width)


def seconds_part(delta: np.ndarray, rounding: str) -> np.ndarray:
    """Seconds component of a time difference: whole seconds modulo one day."""
    whole = np.floor(delta) if rounding == "floor" else np.rint(delta)
    return np.mod(whole, 86400.0)


def series_features(values: list[np.ndarray], times: list[np.ndarray], rounding: str) -> dict[str, np.ndarray]:
    """The order-dependent features of a batch of segments; ``times`` in microseconds."""
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    flat = np.concatenate(values).astype(float) if len(values) else np.zeros(0)
    clock = np.concatenate(times).astype(np.int64) if len(times) else np.zeros(0, dtype=np.int64)
    out = {"n_peaks": flat_peaks(flat, starts, ends)}
    for width in SMOOTH:
        out[f"smooth{width}_n_peaks"] = flat_peaks(*smooth(flat, starts, ends, width))
    d1 = np.diff(flat, append=0.0) if len(flat) else flat
    d2 = np.diff(d1, append=0.0) if len(flat) else flat
    out["diff_peaks"] = flat_peaks(d1, starts, ends - 1)
    out["diff2_peaks"] = flat_peaks(d2, starts, ends - 2)
    gaps = seconds_part(np.diff(clock, append=0) / 1e6, rounding) ** 2 if len(clock) else np.zeros(0)
    out["diff_var"] = np.array([d1[s:e - 1].var() if e - s > 1 else np.nan for s, e in zip(starts, ends)])
    out["diff2_var"] = np.array([d2[s:e - 2].var() if e - s > 2 else np.nan for s, e in zip(starts, ends)])
    out["gaps_squared"] = np.array([gaps[s:e - 1].sum() if e - s > 1 else 0.0 for s, e in zip(starts, ends)])
    return out


# ---- long series: one summary per block -------------------------------------------------

SERIES = ("raw", "smooth10", "smooth20", "diff", "diff2")
HALO = 24


def block_series(x: np.ndarray, first: int, begin: int, end: int, total: int) -> dict[str, np.ndarray]:
    """Each derived series on positions ``begin - 1 .. end - 1`` of a segment.

    ``x`` holds the samples from position ``first`` on, halo included; entry 0 of every result is the
    value before the block (NaN at the start of the segment).
    """
    def window(series: np.ndarray, origin: int, length: int) -> np.ndarray:
        stop = min(end, length)
        body = series[begin - origin:max(stop, begin) - origin]
        before = series[begin - 1 - origin:begin - origin] if begin > 0 else np.array([np.nan])
        return np.concatenate((before, body))

    out = {"raw": window(x, first, total)}
    for width in SMOOTH:
        full = running_means(x, width)
        shift = (min(total, width) - 1) // 2
        out[f"smooth{width}"] = window(full[shift:], first, total)
    out["diff"] = window(np.diff(x), first, total - 1)
    out["diff2"] = window(np.diff(x, n=2), first, total - 2)
    return out


def summarise(values: np.ndarray, need: float) -> dict:
    """Effect of a block on the pass. ``values[0]`` is the sample before the block."""
    body = values[1:]
    body = body[body != values[:-1]]
    s = {"kind": "empty", "low": 0.0, "high": 0.0, "ties": 0, "inner": 0, "rising": False, "at": 0.0, "at_ties": 0}
    if len(body) == 0 or not need > 0:
        return s
    lows, highs = np.minimum.accumulate(body), np.maximum.accumulate(body)
    wide = np.flatnonzero(highs - lows >= need)
    cut = int(wide[0]) if len(wide) else len(body)
    head = body[:cut]
    s["low"], s["high"] = float(head.min()), float(head.max())
    s["ties"] = int((head == s["high"]).sum())
    if cut == len(body):
        s["kind"] = "calm"
        return s
    v = float(body[cut])
    s["kind"] = "up" if v > s["high"] else "down"
    rising, extreme, ties, found = (True, v, 1, 0) if s["kind"] == "up" else (False, v, 0, 0)
    for v in body[cut + 1:].tolist():
        if rising:
            if v > extreme:
                extreme, ties = v, 1
            elif v == extreme:
                ties += 1
            elif extreme - v >= need:
                found += ties
                rising, extreme, ties = False, v, 0
        elif v < extreme:
            extreme = v
        elif v - extreme >= need:
            rising, extreme, ties = True, v, 1
    s.update(inner=found, rising=rising, at=extreme, at_ties=ties)
    return s


def fold(summaries, need: float) -> int:
    """Peak count of a series from its block summaries in order."""
    found, rising, extreme, ties = 0, False, np.inf, 0
    for s in summaries:
        kind = s["kind"]
        if kind == "empty":
            continue
        if kind == "up":
            if rising and extreme - s["low"] >= need:
                found += ties
        elif kind == "down":
            if rising:
                found += ties if extreme > s["high"] else s["ties"] + (ties if extreme == s["high"] else 0)
            elif s["high"] - extreme >= need:
                found += s["ties"]
        elif rising:
            if extreme > s["high"]:
                if extreme - s["low"] >= need:
                    found += ties
                    rising, extreme, ties = False, s["low"], 0
            else:
                ties = s["ties"] + (ties if extreme == s["high"] else 0)
                extreme = s["high"]
        elif s["high"] - extreme >= need:
            rising, extreme, ties = True, s["high"], s["ties"]
        else:
            extreme = min(extreme, s["low"])
        if kind in ("up", "down"):
            found += s["inner"]
            rising, extreme, ties = s["rising"], s["at"], s["at_ties"]
    return found
