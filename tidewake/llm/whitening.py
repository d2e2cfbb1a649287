"""Embedding whitening by a bidiagonal qd solver.

The vectors are fitted as whole numbers (floor of 256 times each entry), each distinct one once, so sums and means are
exact. Their centred rows are reduced by QR in blocks, first within a partition, then the triangles of FAN partitions at a
time, until one triangle R of the vectors' length is left; R'R is n times the covariance, which itself is never formed.
On the driver Householder reflections make R bidiagonal, the dqds algorithm finds its singular values to high relative
accuracy, and twisted factorisations of the bidiagonal's product with its transpose recover the directions. All that
comes to the driver is sized by the length of a vector, not by rows.

Vectors of different lengths are fitted and whitened apart. A component is left out where the variance along it is
zero next to the largest (below LEAST of it), as it has no whitened value: a constant table has no component at all.
Defined results: vectors that are null, empty or hold null or non-finite entries, or such as do not fit whole numbers of 62 bits,
get a null result; a deviation that does not fit a long is null; repeated vectors count once in the fit and get equal
results; an empty table gives an empty result; a column _white of the input is refused, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import free_name, passing, small_batches, stored

SCALE = 256
FAN = 16
LEAST = 1e-20
EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)
LOW = 26  # bits of the lower part of a sum


# the small dense problem ------------------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors) of an upper bidiagonal matrix U' r V; reflector k acts on entries from k + 1 on."""
    a = np.array(r, float)
    n = len(a)
    right: list[np.ndarray] = []

    def reflector(x):
        v = x.copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            return np.zeros_like(x)
        v[0] += np.copysign(norm, x[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 1 < n:
            v = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def back(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """V z for the reflectors of bidiagonal()."""
    out = z.copy()
    for k in range(len(right) - 1, -1, -1):
        out[k + 1 :] -= 2 * right[k] * (right[k] @ out[k + 1 :])
    return out


def _step(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], float, bool]:
    """One dqds transform: new q and e, its last d, and whether all of them but the last are positive."""
    d = q[0] - tau
    new_q, new_e = [], []
    for k in range(len(e)):
        if d < 0:
            return q, e, d, False
        s = d + e[k]
        t = q[k + 1] / s if s > 0 else 0.0
        new_q.append(s)
        new_e.append(e[k] * t)
        d = d * t - tau
    new_q.append(d)
    return new_q, new_e, d, True


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of B'B, squares of the singular values of a bidiagonal with squared entries q and e; falling."""
    out: list[float] = []
    todo = [(list(q), list(e), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        for _ in range(60 * len(q) + 60):
            while e and e[-1] <= EPS * EPS * (moved + q[-1]):
                out.append(moved + q.pop())
                e.pop()
            if not e:
                break
            # an entry that no longer matters splits the rest in two
            cut = next((k for k in range(len(e) - 2, -1, -1) if e[k] <= EPS * EPS * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # graded the wrong way: the transposed problem has the same values
                q, e = _flipped(q, e)
            # the shift: the smaller value of the last two rows, lowered until the transform stays positive
            half, gap = (q[-1] + e[-1] + q[-2]) / 2, q[-1] * q[-2]
            tau = 0.97 * gap / (half + np.sqrt(max(half * half - gap, 0.0)))
            for turn in range(5):
                new_q, new_e, d, ok = _step(q, e, tau)
                if ok and d >= 0:
                    break
                tau = (tau + d) * (1 - 4 * EPS) if ok and turn == 0 and tau + d > 0 else tau / 4 if turn < 3 else 0.0
            q, e, moved = new_q, new_e, moved + tau
        else:
            raise ArithmeticError("the qd iteration does not converge")
        out.extend(moved + x for x in q)
    return sorted(out, reverse=True)


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd array of the same values read from the other end: entries of the lower bidiagonal, brought back to upper form by a zero shift."""
    new_q, new_e, _, _ = _step(q, e, 0.0)
    # rows of the transformed array, reversed, have the same sums and products of neighbours
    back_q, back_e = [], []
    d = new_q[-1]
    for k in range(len(new_e) - 1, -1, -1):
        s = d + new_e[k]
        back_q.append(s)
        t = new_q[k] / s if s > 0 else 0.0
        back_e.append(new_e[k] * t)
        d = d * t
    back_q.append(d)
    return back_q, back_e


@dataclass
class Twisted:
    """Twisted factorisation N G N' of B'B - value, with the twist where the pivot is least."""

    q: np.ndarray
    e: np.ndarray
    value: float
    lower: np.ndarray = field(init=False)
    upper: np.ndarray = field(init=False)
    pivots: np.ndarray = field(init=False)
    twist: int = field(init=False)

    def __post_init__(self):
        n, q, e, x = len(self.q), self.q.tolist(), self.e.tolist(), self.value
        least = TINY / EPS
        plus, minus, s, p = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        s[0] = -x
        for i in range(n - 1):
            plus[i] = (s[i] + q[i]) or least
            s[i + 1] = e[i] / plus[i] * s[i] - x
        plus[-1] = s[-1] + q[-1]
        p[-1] = q[-1] - x
        minus[-1] = p[-1]
        for i in range(n - 2, -1, -1):
            minus[i + 1] = (e[i] + p[i + 1]) or least
            p[i] = p[i + 1] * (q[i] / minus[i + 1]) - x
        minus[0] = p[0]
        gamma = np.array([a + b + x for a, b in zip(s, p, strict=True)])
        self.twist = int(np.argmin(np.abs(gamma)))
        off = np.sqrt(self.q[:-1] * self.e)  # entries beside the diagonal of B'B
        self.lower, self.upper = off / np.array(plus[:-1]), off / np.array(minus[1:])
        r = self.twist
        self.pivots = np.array([*plus[:r], gamma[r] or least * max(x, 1.0), *minus[r + 1 :]])

    def null(self) -> tuple[np.ndarray, float]:
        """(unit vector that the matrix maps to the least, the correction of the value that it speaks for)."""
        z = np.zeros(len(self.q))
        z[self.twist] = 1
        for i in range(self.twist - 1, -1, -1):
            z[i] = -self.lower[i] * z[i + 1]
        for i in range(self.twist, len(z) - 1):
            z[i + 1] = -self.upper[i] * z[i]
        norm = np.linalg.norm(z)
        return z / norm, float(self.pivots[self.twist] / norm**2)

    def solve(self, w: np.ndarray) -> np.ndarray:
        y, r, n = w.astype(float).copy(), self.twist, len(w)
        for i in range(r):
            y[i + 1] -= self.lower[i] * y[i]
        for i in range(n - 1, r, -1):
            y[i - 1] -= self.upper[i - 1] * y[i]
        floor = EPS * max(abs(self.value), TINY / EPS)
        y /= np.where(np.abs(self.pivots) < floor, floor, self.pivots)
        for i in range(r - 1, -1, -1):
            y[i] -= self.lower[i] * y[i + 1]
        for i in range(r, n - 1):
            y[i + 1] -= self.upper[i] * y[i]
        return y


def directions(q: np.ndarray, e: np.ndarray, values: list[float]) -> list[np.ndarray]:
    """Orthonormal eigenvectors of B'B (squared entries q, e, unreduced) for its falling eigenvalues values, each by a twisted factorisation.

    Vectors of values that nearly coincide are made orthogonal; where one would vanish, inverse iteration with the same
    factorisation, orthogonal to those before, takes its place.
    """
    rng = np.random.default_rng(1)
    out: list[np.ndarray] = []
    for x in values:
        for _ in range(3):
            z, more = Twisted(q, e, x).null()
            if abs(more) <= 2 * EPS * abs(x) or abs(more) > 1e-8 * abs(x):
                break
            x += more
        near = np.array([v for v, y in zip(out, values, strict=False) if abs(y - x) <= 1e-3 * max(abs(x), abs(y))]).reshape(-1, len(q))
        rest = z - near.T @ (near @ z)
        if len(near) and np.linalg.norm(rest) < 0.5:
            rest, f = rng.normal(size=len(q)), Twisted(q, e, x * (1 + 64 * EPS))
            for _ in range(4):
                rest -= near.T @ (near @ rest)
                rest = f.solve(rest)
                rest /= np.abs(rest).max()
                rest /= np.linalg.norm(rest)
            rest -= near.T @ (near @ rest)
        rest /= np.linalg.norm(rest)
        rest -= near.T @ (near @ rest)
        out.append(rest / np.linalg.norm(rest))
    return out


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(the largest eigenvalues of r'r, at most so many and none that is zero next to the first, their unit eigenvectors as rows)."""
    scale = np.abs(r).max(initial=0)
    if scale == 0:
        return np.zeros(0), np.zeros((0, r.shape[1]))
    a, b, right = bidiagonal(r / scale)
    b[np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:]) + np.finfo(float).tiny)] = 0
    # a zero on the diagonal is moved by less than rounding has moved it
    q = np.maximum(a * a, (EPS * max(np.abs(a).max(), np.abs(b).max(initial=0)) / len(a)) ** 2)
    e = b * b
    found = []
    edges = [0, *(np.flatnonzero(e == 0) + 1).tolist(), len(q)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        values = dqds(q[lo:hi].tolist(), e[lo : hi - 1].tolist())
        found += [(x, lo, hi, k) for k, x in enumerate(values)]
    found = sorted(found, key=lambda x: (-x[0], x[1], x[3]))[:most]
    found = [x for x in found if x[0] > LEAST * found[0][0]]
    out = np.zeros((len(found), len(q)))
    for lo, hi in {(x[1], x[2]) for x in found}:
        own = [k for k, x in enumerate(found) if x[1] == lo]
        # signs of the entries beside the diagonal: B'B has a_i b_i there, the factorisation its absolute value
        signs = np.concatenate([[1.0], np.cumprod(np.where(a[lo : hi - 1] * b[lo : hi - 1] < 0, -1.0, 1.0))])
        for k, z in zip(own, directions(q[lo:hi], e[lo : hi - 1], [found[k][0] for k in own]), strict=True):
            full = np.zeros(len(q))
            full[lo:hi] = z * signs
            out[k] = back(full, right)
            if out[k][np.argmax(np.abs(out[k]))] < 0:
                out[k] = -out[k]
    return np.array([x[0] for x in found]) * scale * scale, out


# the rows ---------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Whitening of vectors of one length: rows fitted, exact sums, components as rows, their variances, all variance."""

    n: int
    sums: list[int]
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    variance: np.ndarray = field(default_factory=lambda: np.zeros(0))
    total: float = 0.0
    identity_error: float = 0.0

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.part = np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - mean; the whole part of the mean is taken off exactly."""
        return (x - self.whole) - self.part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes.T / np.sqrt(self.variance)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - sum)^2 over the entries of each row, exact; null beyond a long."""
        most = max((self.n * (abs(int(x.min())) + abs(int(x.max()))) + max(map(abs, self.sums)) for _ in range(1) if x.size), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def whole_numbers(vector: Column) -> Column:
    """array<long> of floor(SCALE * entry), null unless every entry is finite."""
    v = vector.cast("array<double>")
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float((1 << 62) // SCALE))), F.lit(False))
    return F.when(sound, F.transform(v, lambda c: F.floor(c * SCALE)))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the column x of a batch."""
    col = batch.column("x")
    flat, sizes = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


SUMS = "dim int, n long, high array<long>, low array<long>"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each length: how many vectors, and their sums in two parts, so that none overflows."""
    total: dict[int, list] = {}
    for batch in batches:
        for d, rows, x in _by_length(batch):
            own = total.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
            own[0] += len(rows)
            own[1] += (x >> LOW).sum(0)
            own[2] += (x & ((1 << LOW) - 1)).sum(0)
    if total:
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        cols = zip(*[(d, n, h.tolist(), low.tolist()) for d, (n, h, low) in total.items()], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["dim", "n", "high", "low"])


def triangle(r: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of the rows of r over those of x; square."""
    out = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
    return np.vstack([out, np.zeros((out.shape[1] - len(out), out.shape[1]))]) if len(out) < out.shape[1] else out


def _triangles(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch):
                found[d] = triangle(found.get(d), models[d].centred(x))
        part = TaskContext.get().partitionId()
        for d, r in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["dim", "part", "r"])

    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    d, r = int(rows.dim.iloc[0]), None
    for x in rows.sort_values("part").r:
        r = triangle(r, np.frombuffer(x).reshape(d, d))
    return pd.DataFrame({"dim": [d], "part": [int(rows.part.min()) // FAN], "r": [r.tobytes()]})


def _moments(models: dict[int, Model]):
    """Sums of whitened rows and of their products, a row for each length of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch):
                w = models[d].whitened(x)
                total[d] = total.get(d, 0) + np.concatenate([w.sum(0), (w.T @ w).ravel()])
        for d, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], names=["dim", "v"])

    return run


def _summed(rows: DataFrame, *cols: str) -> dict[int, tuple[list, ...]]:
    """dim -> the sums of each array column, entry by entry."""
    each = rows.select("dim", F.posexplode(F.arrays_zip(*cols)).alias("at", "z")).groupBy("dim", "at").agg(*[F.sum(f"z.{c}").alias(c) for c in cols])
    found: dict[int, list] = {}
    for r in each.collect():  # a row for each entry of a vector
        found.setdefault(r["dim"], []).append((r["at"], *[r[c] for c in cols]))
    return {d: tuple(zip(*[x[1:] for x in sorted(v)], strict=True)) for d, v in found.items()}


def fitted(x: DataFrame, components: int = 4) -> dict[int, Model]:
    """The models of the vectors in the column x, by their length; each distinct vector counts once."""
    spark = x.sparkSession
    small_batches(spark, 4096)
    with passing(spark):
        fit = stored(x.where("x IS NOT NULL").select("x").distinct(), "white-fit")
        sums = stored(fit.mapInArrow(_sums, SUMS), "white-sums")
        counts = {r["dim"]: r["n"] for r in sums.groupBy("dim").agg(F.sum("n").alias("n")).collect()}
        models = {d: Model(counts[d], [(h << LOW) + low for h, low in zip(*v, strict=True)]) for d, v in _summed(sums, "high", "low").items()}
        if not models:
            return {}
        parts = stored(fit.mapInArrow(_triangles(models), "dim int, part int, r binary"), "white-triangles")
        while parts.agg(F.max("part")).first()[0] > 0:
            parts = stored(parts.groupBy("dim", F.floor(F.col("part") / FAN).alias("_group")).applyInPandas(_merge, "dim int, part int, r binary"), "white-triangles")
        for row in parts.collect():  # one triangle for each length
            d, m = row["dim"], models[row["dim"]]
            r = np.frombuffer(row["r"]).reshape(d, d)
            values, m.axes = principal(r, components)
            m.variance, m.total = values / m.n, float((r * r).sum() / m.n)
        for d, (v,) in _summed(fit.mapInArrow(_moments(models), "dim int, v array<double>"), "v").items():
            m, k = models[d], len(models[d].variance)
            mean, products = np.array(v[:k]) / m.n, np.array(v[k:]).reshape(k, k) / m.n
            m.identity_error = float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return models


def white_udf(models: dict[int, Model]):
    """array<long> -> the struct _white; the models are sized by vectors, not by rows."""
    kinds = {"n": pa.int64(), "deviation": pa.int64(), "whitened": pa.list_(pa.float64()), "explained": pa.list_(pa.float64()), "identity_error": pa.float64()}

    @F.arrow_udf("struct<n:long,deviation:long,whitened:array<double>,explained:array<double>,identity_error:double>")
    def run(xs: pa.Array) -> pa.Array:
        out: list = [None] * len(xs)
        some = np.flatnonzero(xs.is_valid().to_numpy(zero_copy_only=False))
        batch = pa.RecordBatch.from_arrays([xs.drop_null()], names=["x"])
        for d, rows, x in _by_length(batch):
            m = models[d]
            explained = (m.variance / m.total).tolist() if len(m.variance) else []
            for k, dev, w in zip(some[rows].tolist(), m.deviations(x), m.whitened(x).tolist(), strict=True):
                out[k] = {"n": m.n, "deviation": dev, "whitened": w, "explained": explained, "identity_error": m.identity_error}
        return pa.array(out, pa.struct(list(kinds.items())))

    return run


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 4) -> tuple[DataFrame, dict[int, Model]]:
    """rows with a struct column _white: n, deviation, whitened and explained by component, identity_error; and the models by length."""
    free_name(rows, "_white")
    x = whole_numbers(F.col(f"`{vector}`"))
    models = fitted(rows.select(x.alias("x")), components)
    return rows.withColumn("_white", white_udf(models)(x)), models
