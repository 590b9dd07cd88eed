"""The 18 statistics of a growing segment from a small state, equal to those of the whole segment.

Moments are merged chunk by chunk. A peak counts when its prominence is a tenth of the range or more, and the range is known only at the end;
so every series (values, two smoothings, two differences) keeps what may still matter:

* a stack of peaks whose prominence is open: no higher sample and no sample as low as their left base has followed. Heights fall and
  bases rise along it;
* the prominences that are settled, largest range so far permitting: one below a tenth of the present range can never count,
  because ranges only grow, and is dropped.

A peak is settled when a higher sample follows (its prominence reaches to the lowest sample since) or a sample as low as its left base does (it
reaches to that base). Settled prominences beyond ``KEEP`` are handed out (``spill``), so the state does not grow with the segment's length;
who counts peaks adds those handed out.
"""

from __future__ import annotations

import pickle

import numpy as np

from tidemark.functions.series import SERIES, SMOOTH, running_means, seconds_part, series_features

TAIL, KEEP = 64, 4096
PEAKS = ("n_peaks", "smooth10_n_peaks", "smooth20_n_peaks", "diff_peaks", "diff2_peaks")


class Swings:
    """Peaks of one series by prominence, as samples come in."""

    __slots__ = ("low", "high", "last", "way", "base", "open", "settled")

    def __init__(self):
        self.low, self.high = np.inf, -np.inf
        self.last, self.way = None, 0  # newest sample; 1 after a rise, -1 after a fall
        self.base = np.inf  # lowest sample since the newest open peak
        self.open: list[tuple[float, float, float]] = []  # height, left base, lowest sample since the open peak before
        self.settled: list[float] = []

    @property
    def need(self) -> float:
        return 0.1 * (self.high - self.low)

    def copy(self) -> Swings:
        other = Swings()
        other.low, other.high, other.last, other.way, other.base = self.low, self.high, self.last, self.way, self.base
        other.open, other.settled = list(self.open), list(self.settled)
        return other

    def push(self, x: np.ndarray) -> None:
        if not len(x):
            return
        self.low, self.high = min(self.low, float(x.min())), max(self.high, float(x.max()))
        need = self.need
        if self.last is not None:
            x = np.concatenate(([self.last], x))
        x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        self.last = float(x[-1])
        if len(x) < 2:
            return
        up = x[1:] > x[:-1]
        first = self.way == 0
        turned = np.flatnonzero(up != np.concatenate(([up[0] if first else self.way > 0], up[:-1])))
        if first and up[0]:
            self.base = min(self.base, float(x[0]))
        for at in turned.tolist():
            (self._bottom if up[at] else self._top)(float(x[at]), need)
        self.way = 1 if up[-1] else -1
        if len(self.settled) > KEEP:
            self.settled = [p for p in self.settled if p >= need]

    def _top(self, height: float, need: float) -> None:
        base = self.base
        while self.open and self.open[-1][0] < height:
            h, left, since = self.open.pop()
            if h - max(left, base) >= need:
                self.settled.append(h - max(left, base))
            base = min(base, since)
        left = min(base, self.open[-1][1]) if self.open and self.open[-1][0] == height else base
        if height - left >= need:
            self.open.append((height, left, base))
            self.base = np.inf
        else:
            self.base = base

    def _bottom(self, v: float, need: float) -> None:
        self.base = min(self.base, v)
        while self.open and v <= self.open[-1][1]:
            h, left, since = self.open.pop()
            if h - left >= need:
                self.settled.append(h - left)
            self.base = min(self.base, since)

    def count(self) -> int:
        """Peaks among the samples so far, without those handed out."""
        if not self.high > self.low:
            return 0
        need, base = self.need, min(self.base, self.last) if self.way < 0 else self.base
        found = sum(p >= need for p in self.settled)
        for h, left, since in reversed(self.open):
            found += h - max(left, base) >= need
            base = min(base, since)
        return found

    def spill(self) -> list[float]:
        """Settled prominences that no longer have room."""
        self.settled = [p for p in self.settled if p >= self.need]
        if len(self.settled) <= KEEP:
            return []
        out, self.settled = self.settled, []
        return out


def _merge(state: list[float], x: np.ndarray) -> None:
    """Count, mean and central sums up to order four (or two) of a chunk added to those of what came before."""
    if not len(x):
        return
    n, m = len(x), float(x.mean())
    c = x - m
    s2 = float((c * c).sum())
    a, mean, b2 = state[0], state[1], state[2]
    total, d = a + n, m - mean
    if len(state) > 3:
        s3, s4, b3, b4 = float((c ** 3).sum()), float((c ** 4).sum()), state[3], state[4]
        state[4] = b4 + s4 + d ** 4 * a * n * (a * a - a * n + n * n) / total ** 3 + 6 * d * d * (a * a * s2 + n * n * b2) / total ** 2 + 4 * d * (a * s3 - n * b3) / total
        state[3] = b3 + s3 + d ** 3 * a * n * (a - n) / total ** 2 + 3 * d * (a * s2 - n * b2) / total
    state[2] = b2 + s2 + d * d * a * n / total
    state[0], state[1] = total, mean + d * n / total


class Growing:
    """State of one segment; ``rounding`` as in the batch kernel."""

    def __init__(self, rounding: str = "round"):
        self.rounding, self.first, self.gaps = rounding, None, 0.0
        self.values, self.clocks = np.zeros(0), np.zeros(0, np.int64)  # the newest TAIL points
        self.raw, self.d1, self.d2 = [0.0] * 5, [0.0] * 3, [0.0] * 3
        self.swings = [Swings() for _ in SERIES]
        self.handed = False

    @property
    def n(self) -> int:
        return int(self.raw[0])

    def push(self, values: np.ndarray, clocks: np.ndarray) -> None:
        if not len(values):
            return
        self.first = int(clocks[0]) if self.first is None else self.first
        before, old = self.n, len(self.values)
        x, t = np.concatenate((self.values, values)), np.concatenate((self.clocks, clocks))
        if len(t) > 1:
            self.gaps += float((seconds_part(np.diff(t[max(old - 1, 0):]) / 1e6, self.rounding) ** 2).sum())
        _merge(self.raw, np.asarray(values, float))
        d1, d2 = np.diff(x), np.diff(x, n=2)
        d1, d2 = d1[max(old - 1, 0):], d2[max(old - 2, 0):]
        _merge(self.d1, d1)
        _merge(self.d2, d2)
        fresh = [values]
        for width in SMOOTH:
            shift = (width - 1) // 2
            # Entry k of the full product is about sample k; what is complete moves on by as many as came in.
            ready, done = before + len(values) - shift, max(before - shift, 0)
            full = running_means(x, width)
            origin = before - old
            fresh.append(full[max(done + shift - origin, 0):ready + shift - origin] if ready > done else x[:0])
        for s, part in zip(self.swings, [*fresh, d1, d2]):
            s.push(part)
        self.values, self.clocks = x[-TAIL:], t[-TAIL:]

    def features(self) -> dict:
        """Length, moments, order features and needs; NaN where the batch kernel has NaN."""
        n, _, s2, s3, s4 = self.raw
        out = {"len": self.n, "mean": self.raw[1], "var": s2 / n, "std": (s2 / n) ** 0.5, "kurtosis": n * s4 / (s2 * s2) - 3 if s2 > 0 else None,
               "skew": n ** 0.5 * s3 / s2 ** 1.5 if s2 > 0 else None, "gaps_squared": self.gaps,
               "diff_var": self.d1[2] / self.d1[0] if self.d1[0] else None, "diff2_var": self.d2[2] / self.d2[0] if self.d2[0] else None}
        if self.n <= TAIL:
            own = series_features([self.values], [self.clocks], self.rounding)
            return out | {k: int(own[k][0]) for k in PEAKS} | {"needs": None}
        swings = list(self.swings)
        for k, width in enumerate(SMOOTH, 1):
            shift = (width - 1) // 2
            full = running_means(self.values, width)
            swings[k] = swings[k].copy()
            swings[k].push(full[len(self.values):len(self.values) + shift])
        return out | {k: s.count() for k, s in zip(PEAKS, swings)} | {"needs": [s.need if s.high > s.low else None for s in swings]}

    def spill(self) -> list[tuple[str, list[float]]]:
        out = [(name, part) for name, s in zip(PEAKS, self.swings) if (part := s.spill())]
        self.handed = self.handed or bool(out)
        return out

    def dump(self) -> bytes:
        return pickle.dumps((self.rounding, self.first, self.gaps, self.values.tobytes(), self.clocks.tobytes(), self.raw, self.d1, self.d2, self.handed,
                             [(s.low, s.high, s.last, s.way, s.base, s.open, s.settled) for s in self.swings]), protocol=5)

    @classmethod
    def load(cls, state: bytes) -> Growing:
        rounding, first, gaps, values, clocks, raw, d1, d2, handed, swings = pickle.loads(state)
        g = cls(rounding)
        g.first, g.gaps, g.raw, g.d1, g.d2, g.handed = first, gaps, raw, d1, d2, handed
        g.values, g.clocks = np.frombuffer(values).copy(), np.frombuffer(clocks, np.int64).copy()
        for s, (s.low, s.high, s.last, s.way, s.base, s.open, s.settled) in zip(g.swings, swings):
            pass
        return g
