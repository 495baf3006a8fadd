"""Embedding whitening: project vectors on their leading principal components, each to unit variance.

1. Vectors are rounded to integers ``x = floor(256 * c)`` and made distinct (the fit list).
2. Two passes over the fit list: exact sums of every dimension, then the covariance of the centred vectors.
   Each partition adds up its own matrix; entries are summed by place. Only dimension^2 numbers reach the driver.
3. Its leading eigenpairs: Householder reflections to tridiagonal form, bisection on Sturm counts for the
   eigenvalues, inverse iteration for the eigenvectors, where vectors of a cluster of eigenvalues are
   orthogonalised against each other in every iteration.
4. The components (k x dimension) are broadcast and every row is projected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pinned

SCALE = 256
COMPONENTS = 4
_EPS = np.finfo(float).eps


# ---------------------------------------------------------------- symmetric eigenproblem, leading pairs
def tridiagonal(a: np.ndarray):
    """Diagonal, off-diagonal and the unit Householder vectors of a symmetric matrix."""
    a = np.array(a, float)
    n, mirrors = len(a), []
    for j in range(n - 2):
        x = a[j + 1:, j]
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            mirrors.append(None)
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        b = a[j + 1:, j + 1:]
        p = b @ v
        w = p - (v @ p) * v
        b -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[j + 1, j] = a[j, j + 1] = -np.copysign(size, x[0])
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_count(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix (d, e) lie below each x: negative pivots of its factorisation."""
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(e * e, initial=0.0))) / _EPS
    below, q = np.zeros(len(x), int), None
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of Gershgorin's interval."""
    n = len(d)
    r = np.zeros(n)
    r[:-1] += np.abs(e)
    r[1:] += np.abs(e)
    spread = max(float(np.max(np.abs(d) + r)), np.finfo(float).tiny)
    lo, hi = np.full(k, float(np.min(d - r)) - _EPS * spread * n), np.full(k, float(np.max(d + r)) + _EPS * spread * n)
    rank = n - np.arange(k)                        # the i-th largest has at least n - i eigenvalues below any x above it
    for _ in range(2000):
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi) | (hi - lo <= 2 * _EPS * np.maximum(np.abs(lo), np.abs(hi)))):
            break
        above = sturm_count(d, e, mid) >= rank
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    return lo + (hi - lo) / 2


def _solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """x of (T - shift) x = b by elimination with partial pivoting; a zero pivot becomes a tiny one."""
    n = len(d)
    tiny = _EPS * max(float(np.max(np.abs(d))), float(np.max(np.abs(e), initial=0.0)), np.finfo(float).tiny)
    p, q, r, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        low = e[i]
        if abs(low) > abs(p[i]):                   # swap rows i and i + 1
            top = (p[i], q[i], r[i], x[i])
            p[i], q[i], r[i], x[i] = low, p[i + 1], q[i + 1], x[i + 1]
            m = top[0] / low
            p[i + 1], q[i + 1] = top[1] - m * q[i], top[2] - m * r[i]
            x[i + 1] = top[3] - m * x[i]
        else:
            if p[i] == 0:
                p[i] = tiny
            m = low / p[i]
            p[i + 1] -= m * q[i]
            x[i + 1] -= m * x[i]
    for i in range(n - 1, -1, -1):
        rest = x[i] - (q[i] * x[i + 1] if i + 1 < n else 0.0) - (r[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / (p[i] if abs(p[i]) > tiny else np.copysign(tiny, p[i] or 1.0))
        if abs(x[i]) > 1e150:                      # a nearly singular system: only the direction counts
            x /= 1e150
    return x


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray, close: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Unit eigenvectors (rows) of falling eigenvalues; those of a cluster are orthogonalised in every iteration.

    A cluster is a run of eigenvalues of which neighbours differ by at most ``close`` times the largest.
    """
    rng, n = np.random.default_rng(seed), len(d)
    size = max(float(np.max(np.abs(values), initial=0.0)), np.finfo(float).tiny)
    out, start, used = np.zeros((len(values), n)), 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > close * size:
            start = i
        shift = min(value, used - 4 * _EPS * size) if i > start else value      # equal eigenvalues get shifts apart
        used = shift
        x = rng.standard_normal(n)
        for _ in range(8):
            x = _solve_shifted(d, e, shift, x / np.linalg.norm(x))
            x /= np.linalg.norm(x)
            for _ in range(2):
                for y in out[start:i]:
                    x -= (y @ x) * y
            x /= np.linalg.norm(x)
            t = d * x - value * x
            t[:-1] += e * x[1:]
            t[1:] += e * x[:-1]
            if np.linalg.norm(t) <= 8 * _EPS * size * np.sqrt(n):
                break
        out[i] = x
    return out


def leading_eigenpairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    An eigenvector's largest entry is positive.
    """
    n = len(a)
    k = min(k, n)
    scale = float(np.max(np.abs(a), initial=0.0))
    if not k or scale == 0:
        return np.zeros(k), np.eye(k, n)
    d, e, mirrors = tridiagonal(np.asarray(a, float) / scale)
    values = leading_eigenvalues(d, e, k)
    z = inverse_iteration(d, e, values)
    for j in range(len(mirrors) - 1, -1, -1):
        if mirrors[j] is not None:
            z[:, j + 1:] -= 2.0 * np.outer(z[:, j + 1:] @ mirrors[j], mirrors[j])
    return values * scale, z * np.where(z[np.arange(k), np.argmax(np.abs(z), axis=1)] < 0, -1.0, 1.0)[:, None]


# ---------------------------------------------------------------- distributed fit
@dataclass
class Whitening:
    """A fitted whitening: the fit list's size and sums, components (rows), their eigenvalues, the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = float("nan")

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components.T / np.sqrt(self.values)


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of an Arrow list column of ``dim`` integers each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def _entry_sums(x: DataFrame, dim: int, rows, size: int, kind: str) -> np.ndarray:
    """Sum over all vectors of ``rows(matrix) -> size numbers``: added up by partition, then by place."""
    numpy_type, arrow_type = (np.int64, pa.int64()) if kind == "long" else (np.float64, pa.float64())

    def run(batches):
        total = np.zeros(size, numpy_type)
        for b in batches:
            if b.num_rows:
                total += rows(_matrix(b.column("x"), dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total, arrow_type)], names=["at", "v"])

    out = np.zeros(size, numpy_type)
    for r in x.select("x").mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect():     # size rows
        out[r.at] = r.v
    return out


def covariance(x: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Covariance (divisor n) of the rows ``x``, centred before multiplying; entry n counts them."""
    dim = len(mean)
    upper = np.triu_indices(dim)

    def rows(m):
        z = m - mean
        return np.append((z.T @ z)[upper], float(len(m)))

    s = _entry_sums(x, dim, rows, len(upper[0]) + 1, "double")
    out = np.zeros((dim, dim))
    out[upper] = s[:-1] / max(s[-1], 1.0)
    return out + np.triu(out, 1).T


def rounded_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with ``x``, the vector's entries as ``floor(256 * c)``; rows of null vectors or null or non-finite entries stay out."""
    c = F.col(vector)
    ok = c.isNotNull() & F.forall(c, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return df.where(ok).withColumn("x", F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long")))


def fit_whitening(x: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct rows of ``x`` (array<long>); None where there are none.

    Vectors of another length than the most frequent one (ties: the longer) stay out. Components whose
    eigenvalue is zero to double precision stay out, as nothing can be scaled to unit variance there.
    """
    fit = pinned(x.select("x").distinct(), "whitening-fit")
    sizes = fit.where(F.size("x") > 0).groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return None
    dim, n = int(sizes["dim"]), int(sizes["count"])
    fit = fit.where(F.size("x") == dim)
    sums = _entry_sums(fit, dim, lambda m: m.sum(axis=0), dim, "long")
    cov = covariance(fit, sums / n)
    values, components = leading_eigenpairs(cov, k)
    keep = values > dim * _EPS * max(float(np.trace(cov)), 0.0)
    model = Whitening(n, sums, components[keep], values[keep], float(np.trace(cov)))
    if keep.any():
        kept, upper = int(keep.sum()), np.triu_indices(int(keep.sum()))

        def rows(m):
            w = model.project(m)                   # the mean of the projected fit list is 0 up to rounding, it is taken off below
            return np.concatenate([(w.T @ w)[upper], w.sum(axis=0)])

        s = _entry_sums(fit, dim, rows, len(upper[0]) + kept, "double")
        mean = s[len(upper[0]):] / n
        got = s[:len(upper[0])] / n - mean[upper[0]] * mean[upper[1]]
        model.identity_error = float(np.max(np.abs(got - (upper[0] == upper[1]))))
    return model


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``df`` and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null, or holds null or non-finite entries, stay out, as do vectors of a rarer
    length. The model is fitted on the distinct rounded vectors, so copies weigh once, but every row gets
    its result; repeated and null ids keep a row each. Fewer than ``k`` components come out where the
    dimension or the rank is smaller (none if all vectors are equal). ``deviation`` is null where it does
    not fit a long. An empty table gives no rows. Further columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rounded_vectors(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("_vector")), "_vector").select("vec_id", "x")
    model = fit_whitening(rows, k)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    dim = len(model.sums)
    shared = df.sparkSession.sparkContext.broadcast(model)               # k x dimension numbers

    def run(batches):
        m = shared.value
        kept = len(m.values)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), dim)
            far = m.n * x - m.sums                                       # wraps where it overflows; exact where the total fits
            about = (((m.n * x.astype(float) - m.sums) ** 2).sum(axis=1)) < 9.2e18
            deviation = pa.array((far * far).sum(axis=1), mask=~about)
            w = m.project(x)
            each = np.repeat(np.arange(len(x)), kept)
            const = lambda v, t: pa.array(np.full(len(each), v), t)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), const(m.n, pa.int64()),
                 deviation.take(pa.array(each)), pa.array(w.reshape(-1)), pa.array(np.tile(m.values / m.trace, len(x))), const(m.identity_error, pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == dim).mapInArrow(run, schema)
