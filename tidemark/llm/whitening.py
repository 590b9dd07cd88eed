"""Whitening of embeddings by incremental eigendecomposition.

A partition keeps the eigenvectors and eigenvalues of the scatter of the vectors it has seen. A new vector, centred on the running mean, changes
the scatter by a rank-one term: its part outside the present eigenvectors becomes a new direction, and the new eigenvalues are the roots of
the secular equation 1 + rho * sum(z_j^2 / (d_j - x)) = 0, one between every two old ones. Entries of z that are nearly zero and eigenvalues that
are nearly equal are deflated: the one pair stays as it is, the other is turned by a rotation first. The weights z are worked out anew
from the roots, which keeps the new eigenvectors at right angles. Equal vectors of a batch are one update of their number's weight.

The spectra of partitions are merged in groups, level by level, each by successive rank-one updates: one for every eigenvector of the smaller
one, and one for the distance of the means. A Rayleigh-Ritz refinement over all rows follows: with Q the leading eigenvectors and a few more, the rows
give V Q, the Ritz pairs of Q are the result, and their residuals tell how good they are; while a residual is above the tolerance, V Q
is the next Q. The merged spectrum decides how many of these passes are needed; mostly one is.

Memory: a task holds one spectrum, dimension x dimension numbers; the driver gets one spectrum and sums of dimension x (components + 8).

Nulls and edges: vectors that are null, empty, hold nulls or non-finite entries or entries of 2^40 or more are left out, and so are vectors of another length than the commonest
(ties: the shortest). A component without spread has null ``whitened``, and an explained share of zero (null where no component has any). Repeated rows
count each and are returned each. ``deviation`` is null where it is too large for a long. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Shelf

EPS = np.finfo(float).eps
SCALE, SHIFT, LARGEST = 1024.0, 100_000, 2.0**40
MORE, PASSES, FAN = 8, 30, 16
#: Updates after which a task makes its eigenvectors orthogonal again.
RENEW = 2048


# ---- secular equation

def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_j^2 / (d_j - x)), rho > 0, d rising and apart, no z zero: for each the nearest pole's number, and the root less that pole.

    All roots at once: steps by a quotient that has the poles on both sides of a root, halvings where a step leaves the root's bracket.
    """
    m = len(d)
    z2 = rho * z * z
    total = z2.sum()
    if m == 1:
        return np.zeros(1, int), np.array([total])
    k = np.arange(m)
    gap = np.append(np.diff(d), total)
    middle = d + gap / 2
    value = 1 + (z2 / (d[None, :] - middle[:, None])).sum(axis=1)
    right = (value < 0) & (k < m - 1)  # nearer to the pole above
    pole = k + right
    at = d[None, :] - d[pole][:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    last_far = value[-1] < 0
    if last_far:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    x = np.where(right, -gap / 4, gap / 4)
    x[-1] = (low[-1] + high[-1]) / 2
    end, rows, root_z, up_to = m - 1, k, np.sqrt(z2), np.tri(m)  # rows: roots not settled yet
    for _ in range(80):
        y = x[rows]
        apart = (at if len(rows) == m else at[rows]) - y[:, None]
        part = root_z / apart
        f, bound = 1 + part @ root_z, np.abs(part) @ root_z
        np.multiply(part, part, out=part)
        both = part @ np.ones(m)
        open_ = np.flatnonzero(np.abs(f) > 8 * EPS * (1 + bound + np.abs(y) * both))
        if not len(open_):
            break
        if len(open_) < len(rows):
            rows, y, f, both, apart, part = rows[open_], y[open_], f[open_], both[open_], apart[open_], part[open_]
        under = f < 0
        low[rows], high[rows] = np.where(under, np.maximum(low[rows], y), low[rows]), np.where(under, high[rows], np.minimum(high[rows], y))
        here = np.arange(len(rows))
        with np.errstate(all="ignore"):
            below = np.einsum("ij,ij->i", part, up_to[rows])  # of the poles below the root
            a, b = apart[here, rows], apart[here, np.minimum(rows + 1, end)]
            c = f - a * below - b * (both - below)
            p, q = (a + b) * f - a * b * both, a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0.0))
            new = y + np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            # The last root has poles on one side only: a constant and one pole.
            s = b * b * both
            new = np.where(rows == end, y + b + s / (f - s / b), new)
        x[rows] = np.where((new > low[rows]) & (new < high[rows]), new, (low[rows] + high[rows]) / 2)
    return pole, x


def rank_one(q: np.ndarray, d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors and rising eigenvalues of q (diag(d) + rho z z') q', given rising d."""
    norm = np.sqrt(z @ z)
    if not len(d) or norm == 0 or rho <= 0:
        return q, d
    z, rho = z / norm, rho * norm * norm
    tol = 8 * EPS * max(abs(d[-1]), rho)
    keep = rho * np.abs(z) > tol
    close = np.flatnonzero(np.diff(d[keep]) <= tol)
    if len(close):  # equal eigenvalues: turn the pair so that one of them is out of it
        q, d, z = q.copy(), d.copy(), z.copy()
        place = np.flatnonzero(keep)
        for n in close.tolist():
            i, j = place[n], place[n + 1]
            r = np.hypot(z[i], z[j])
            cos, sin = z[j] / r, z[i] / r
            q[:, i], q[:, j] = cos * q[:, i] - sin * q[:, j], sin * q[:, i] + cos * q[:, j]
            d[i], d[j] = cos * cos * d[i] + sin * sin * d[j], sin * sin * d[i] + cos * cos * d[j]
            z[i], z[j] = 0.0, r
            keep[i] = False
    dk, zk = d[keep], z[keep]
    if not len(dk):
        return q, d
    by = None
    if len(close) and np.any(np.diff(dk) <= 0):
        by = np.argsort(dk, kind="stable")
        dk, zk = dk[by], zk[by]
        if np.any(np.diff(dk) <= 0):  # what rotations left equal to the last bit
            dk = dk + np.arange(len(dk)) * EPS * max(abs(dk[-1]), rho)
    pole, x = secular_roots(dk, zk, rho)
    away = (dk[None, :] - dk[pole][:, None]) - x[:, None]  # pole j less root i
    other = dk[:, None] - dk[None, :]
    np.fill_diagonal(other, 1.0)
    ratio = -away / other  # (root i - pole j) / (pole i - pole j)
    weight = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(zk)
    vectors = weight[None, :] / away
    vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    side = q[:, keep] if by is None else q[:, keep][:, by]
    values = np.append(dk[pole] + x, d[~keep])
    whole = np.concatenate([side @ vectors.T, q[:, ~keep]], axis=1)
    order = np.argsort(values, kind="stable")
    return np.ascontiguousarray(whole[:, order]), values[order]


class Spectrum:
    """Number, mean, and the scatter's eigenvectors and rising eigenvalues; no more directions than were seen."""

    def __init__(self, dimension: int):
        self.n, self.mean = 0, np.zeros(dimension)
        self.q, self.d, self.updates = np.zeros((dimension, 0)), np.zeros(0), 0

    def turn(self, u: np.ndarray, rho: float) -> None:
        """Adds rho u u' to the scatter."""
        z = self.q.T @ u
        if len(self.d) < len(u):
            out = u - self.q @ z
            out -= self.q @ (self.q.T @ out)
            left = np.sqrt(out @ out)
            if left > 1e-10 * np.sqrt(u @ u):
                self.q, self.d, z = np.column_stack([out / left, self.q]), np.append(0.0, self.d), np.append(left, z)
        self.q, self.d = rank_one(self.q, self.d, z, rho)
        self.updates += 1
        if self.updates % RENEW == 0 and len(self.d):
            self.q, turned = np.linalg.qr(self.q)
            self.q *= np.sign(np.diag(turned))

    def add(self, x: np.ndarray, times: int = 1) -> None:
        u = x - self.mean
        if self.n and u.any():
            self.turn(u, self.n * times / (self.n + times))
        self.n += times
        self.mean = self.mean + u * (times / self.n)

    def merge(self, other: Spectrum) -> Spectrum:
        big, small = (self, other) if len(self.d) >= len(other.d) else (other, self)
        if small.n:
            apart = small.mean - big.mean
            for j in range(len(small.d)):
                if small.d[j] > 0:
                    big.turn(small.q[:, j], small.d[j])
            if big.n and apart.any():
                big.turn(apart, big.n * small.n / (big.n + small.n))
            big.n += small.n
            big.mean = big.mean + apart * (small.n / big.n)
        return big

    def row(self) -> tuple:
        return self.n, self.mean.tolist(), self.d.tolist(), self.q.T.ravel().tolist()

    @classmethod
    def of(cls, n: int, mean, d, q) -> Spectrum:
        made = cls(len(mean))
        made.n, made.mean, made.d = n, np.array(mean, float), np.array(d, float)
        made.q = np.array(q, float).reshape(len(made.d), len(mean)).T.copy()
        return made


# ---- over a table

def integer_vectors(rows: DataFrame, shelf: Shelf, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and x, the entries as long: floor(1024 c) + 100000."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    good = rows.select(F.col(key).alias("vec_id"), entries.alias("c")).filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    stored = shelf.put(good.select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT).alias("x")), "vectors")
    usual = stored.groupBy(F.size("x").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    return stored.filter(F.size("x") == usual["size"]) if usual else stored


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


_STATE = "part int, n bigint, mean array<double>, d array<double>, q array<double>, sums array<bigint>"


def spectrum(vectors: DataFrame, shelf: Shelf) -> tuple[Spectrum, np.ndarray]:
    """The whole scatter's spectrum and the exact sums of x. vectors: x, at least one row."""
    def own(batches):
        state, sums = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, times = np.unique(_matrix(batch.column(0)), axis=0, return_counts=True)
            state = state or Spectrum(x.shape[1])
            sums = sums + (x * times[:, None]).sum(axis=0)
            for row, n in zip(x.astype(float), times.tolist()):
                state.add(row, n)
        if state is not None:
            yield _batch(0, state, sums)

    def merged(key, few):
        state, sums = None, 0
        for r in few.to_pylist():
            one = Spectrum.of(r["n"], r["mean"], r["d"], r["q"])
            state, sums = one if state is None else state.merge(one), sums + np.array(r["sums"], np.int64)
        return pa.Table.from_batches([_batch(key[0].as_py(), state, sums)])

    def _batch(part, state, sums):
        n, mean, d, q = state.row()
        return pa.RecordBatch.from_pylist([{"part": part, "n": n, "mean": mean, "d": d, "q": q, "sums": sums.tolist()}], schema=_arrow_state())

    level, n = shelf.put(vectors.select("x").mapInArrow(own, _STATE).withColumn("part", F.spark_partition_id()), "spectra-0"), 0
    while level.count() > 1:
        n += 1
        level = shelf.put(level.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(merged, _STATE), f"spectra-{n}")
    r = level.first()
    return Spectrum.of(r.n, r.mean, r.d, r.q), np.array(r.sums, np.int64)


def _arrow_state() -> pa.Schema:
    reals = pa.list_(pa.float64())
    return pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", reals), ("d", reals), ("q", reals), ("sums", pa.list_(pa.int64()))])


def _summed(vectors: DataFrame, make) -> np.ndarray:
    """The sum over all rows of what ``make`` gives of a batch's matrix, added up in Spark entry by entry."""
    def own(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                got = make(_matrix(batch.column(0)))
                total = got if total is None else total + got
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int64)), pa.array(flat)], names=["i", "v"])

    got = vectors.select("x").mapInArrow(own, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(got.num_rows)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def components(vectors: DataFrame, shelf: Shelf, wanted: int = 8, tolerance: float = 1e-13) -> dict:
    """n, sums, mean, values and vectors (columns) of the leading components, trace of V, passes of the refinement."""
    whole, sums = spectrum(vectors, shelf)
    n, dim = whole.n, len(whole.mean)
    mean = np.array([int(s) // n + (int(s) % n) / n for s in sums.tolist()])
    k = min(wanted, dim)
    width = min(dim, k + MORE)
    q = whole.q[:, ::-1][:, :width]
    if q.shape[1] < width:  # directions without spread
        q = np.column_stack([q, np.eye(dim)])
    q = np.linalg.qr(q)[0][:, :width]
    for passes in range(1, PASSES + 1):
        def products(x, q=q):
            centred = x - mean
            return np.append(centred.T @ (centred @ q), (centred * centred).sum())
        got = _summed(vectors, products)
        y, trace = got[:-1].reshape(dim, width) / n, got[-1] / n
        values, turned = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        ritz = q @ turned
        left = np.sqrt(((y @ turned - ritz * values) ** 2).sum(axis=0))[:k].max()
        if left <= tolerance * max(values[0], 0.0) or width == dim:
            break
        q = np.linalg.qr(y @ turned)[0]
    ritz = ritz[:, :k]
    sign = np.sign(ritz[np.abs(ritz).argmax(axis=0), np.arange(k)])
    return {"n": n, "sums": sums, "mean": mean, "values": np.where(values[:k] > 1e-12 * max(values[0], 0.0), values[:k], 0.0), "vectors": ritz * sign, "trace": float(trace),
            "passes": passes}


def whiten(rows: DataFrame, wanted: int = 8, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per remaining vector and component."""
    shelf = Shelf(rows.sparkSession, "whitening")
    vectors = integer_vectors(rows, shelf, vector, key)
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if vectors.isEmpty():
        return rows.sparkSession.createDataFrame([], schema)
    found = components(vectors, shelf, wanted)
    n, sums, mean, values, trace = (found[c] for c in ("n", "sums", "mean", "values", "trace"))
    spread = values > 0
    map_to = found["vectors"][:, spread] / np.sqrt(values[spread])
    error = 0.0
    if spread.any():
        # Centred before it is multiplied: first the whitened columns' means, then their products.
        means = _summed(vectors, lambda x: ((x - mean) @ map_to).sum(axis=0)) / n

        def squares(x):
            w = (x - mean) @ map_to - means
            return w.T @ w
        error = float(np.abs(_summed(vectors, squares).reshape(len(means), -1) / n - np.eye(len(means))).max())
    places, share = np.flatnonzero(spread), (values / trace if trace > 0 else np.full(len(values), np.nan))
    numbers = np.arange(1, len(values) + 1, dtype=np.int32)

    def deviations(x: np.ndarray) -> list[int | None]:
        far = max(int(np.abs(x).max()) * n, int(np.abs(sums).max())) * 2
        if far ** 2 * x.shape[1] < 2**63:
            apart = x * n - sums
            return (apart * apart).sum(axis=1).tolist()
        apart = x.astype(object) * n - sums.astype(object)
        small = max(map(abs, apart.ravel().tolist()))
        if small ** 2 * x.shape[1] < 2**63:
            apart = apart.astype(np.int64)
            return (apart * apart).sum(axis=1).tolist()
        return [s if s < 2**63 else None for s in (apart * apart).sum(axis=1).tolist()]

    def out(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            k, rows_ = len(numbers), len(x)
            white = np.full((rows_, k), np.nan)
            white[:, places] = (x - mean) @ map_to
            again = np.repeat(np.arange(rows_), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(again)), pa.array(np.tile(numbers, rows_)), pa.array(np.full(rows_ * k, n, np.int64)),
                pa.array(deviations(x), pa.int64()).take(pa.array(again)), pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(share, rows_), from_pandas=True),
                pa.array(np.full(rows_ * k, error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", "x").mapInArrow(out, schema)
