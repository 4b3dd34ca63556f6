"""Whitening of embeddings on their leading principal components.

A vector becomes whole numbers x = floor(SCALE * c).  The model is fitted on
each distinct x once: Spark adds up the sums S of every dimension exactly, then
one d x d matrix of centred products per task, which are added by row.  The
d x d covariance reaches the driver (its size depends on the dimension alone)
and is decomposed there: Householder reflections make it tridiagonal, bisection
on Sturm counts finds the leading eigenvalues, inverse iteration their vectors,
and vectors of eigenvalues that lie close together are made orthogonal to each
other.  The tasks get the mean and the components and project every row.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries are dropped, as are those whose length is not the most frequent one
(the longer, if equal); entries beyond 2^62 / SCALE count as that; repeated
rows are projected each but fitted once; a component whose eigenvalue is not
above ``RANK`` times the trace carries no direction: its whitened value is
null; deviation is null where it does not fit a long; an empty table gives no
rows.  Other columns are dropped but for ``key``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm._store import stored, tidy

SCALE = 256
COMPONENTS = 4
RANK = 1e-13
_TOP = 2**62


# -- symmetric eigenproblem -------------------------------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q @ t @ q.T, by Householder reflections."""
    a, d = np.array(a, float), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        norm = np.sqrt(v @ v)
        if norm == 0:
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.sqrt(v @ v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def sturm_counts(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues of the tridiagonal matrix below each value of ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float(np.abs(off).max(initial=0)) ** 2)
    count = np.zeros(len(at), int)
    pivot = np.full(len(at), 1.0)
    for k in range(len(diag)):
        pivot = diag[k] - at - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` largest eigenvalues, falling, by bisection to the last bits."""
    d = len(diag)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = np.full(n, (diag - reach).min()), np.full(n, (diag + reach).max())
    low, high = low - 1e-12 * np.abs(low) - 1e-300, high + 1e-12 * np.abs(high) + 1e-300
    rank = d - 1 - np.arange(n)                # eigenvalue j (from 0, rising): more than j lie below its upper ends
    for _ in range(2100):
        mid = low + (high - low) / 2
        if np.all((mid <= low) | (mid >= high)):
            break
        above = sturm_counts(diag, off, mid) > rank
        high, low = np.where(above, mid, high), np.where(above, low, mid)
    return low + (high - low) / 2


def _solver(diag: np.ndarray, off: np.ndarray, shift: float, floor: float):
    """Solution of (t - shift) x = b by elimination with row exchanges; vanishing pivots become ``floor``."""
    d = len(diag)
    u = np.zeros((d, 3))                       # rows of the upper factor: pivot and two to its right
    steps = []
    row = np.array([diag[0] - shift, off[0] if d > 1 else 0.0, 0.0])
    for k in range(d - 1):
        below = np.array([off[k], diag[k + 1] - shift, off[k + 1] if k + 2 < d else 0.0])
        swap = abs(below[0]) > abs(row[0])
        if swap:
            row, below = below, row
        if abs(row[0]) < floor:
            row[0] = floor
        factor = below[0] / row[0]
        u[k] = row
        row = np.array([below[1] - factor * row[1], below[2] - factor * row[2], 0.0])
        steps.append((swap, factor))
    if abs(row[0]) < floor:
        row[0] = floor
    u[d - 1] = row

    def solve(b):
        x = np.array(b, float)
        for k, (swap, factor) in enumerate(steps):
            if swap:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= factor * x[k]
        for k in range(d - 1, -1, -1):
            right = x[k + 1: k + 3]
            x[k] = (x[k] - u[k, 1: 1 + len(right)] @ right) / u[k, 0]
            top = np.abs(x[k:]).max()
            if top > 1e200:                    # only the direction matters
                x /= top
        return x

    return solve


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix for its falling eigenvalues ``values``.

    Values closer than a thousandth of the matrix's norm form a cluster, in which
    each vector is kept orthogonal to those before it.
    """
    d = len(diag)
    norm = max(float(np.abs(diag).max(initial=0)), float(np.abs(off).max(initial=0)), 1e-300)
    eps = np.finfo(float).eps
    rng = np.random.default_rng(13)
    vectors = np.zeros((d, len(values)))
    cluster = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        shift = value - (j - cluster) * 4 * eps * norm        # equal values: distinct shifts
        solve = _solver(diag, off, shift, eps * norm)
        mine = vectors[:, cluster:j]
        x = rng.normal(size=d)
        for _ in range(8):
            x -= mine @ (mine.T @ x)
            x = solve(x / np.sqrt(x @ x))
            x /= np.abs(x).max()
            x -= mine @ (mine.T @ x)
            x -= mine @ (mine.T @ x)
            before, x = x, x / np.sqrt(x @ x)
            if np.abs(diag * x + np.append(off * x[1:], 0) + np.append(0, off * x[:-1]) - value * x).max() < 4 * eps * norm:
                break
        vectors[:, j] = x
    return vectors


def leading_components(a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix, ``n`` at most."""
    n = min(n, len(a))
    scale = float(np.abs(a).max(initial=0))
    if scale == 0:
        return np.zeros(n), np.eye(len(a))[:, :n]
    diag, off, q = tridiagonal(a / scale)
    values = leading_values(diag, off, n)
    vectors = q @ inverse_iteration(diag, off, values)
    return values * scale, vectors / np.sqrt((vectors * vectors).sum(0))


# -- distributed fit ----------------------------------------------------------------------

def whole_numbers(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x array<long>) of the usable rows; x = floor(SCALE * c)."""
    v = F.col(vector)
    usable = (v.isNotNull() & (F.size(v) > 0)
              & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    bound = float(_TOP)
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(bound)), F.lit(-bound)))
                    .cast("long"))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select(key, x.alias("x"))


def _matrix(column) -> np.ndarray:
    """The lists of a column, all of one length, as an (n, d) array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(table: DataFrame, d: int, of_batch) -> np.ndarray:
    """Sum of the (m, d) matrices that ``of_batch`` makes of the batches; a task sends its own sum, Spark adds by entry."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                made = of_batch(_matrix(batch.column(0)))
                total = made if total is None else total + made
        if total is not None:
            i, j = np.divmod(np.arange(total.size), total.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(total.ravel())], ["i", "j", "v"])

    kind = "long" if of_batch is _sums else "double"
    rows = (table.mapInArrow(run, f"i int, j int, v {kind}")
            .groupBy("i", "j").agg(F.sum("v").alias("v"))).toArrow()    # d * d rows at most
    out = np.zeros((int(rows["i"].to_numpy().max()) + 1, d), np.int64 if kind == "long" else float)
    out[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["v"].to_numpy()
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    return x.sum(0, keepdims=True)


@dataclass
class Whitener:
    """A fitted model: how many vectors, their sums, eigenvalues, components (columns), trace, identity error."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        return self.values > RANK * self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, with the difference taken in whole numbers where they fit."""
        if len(x) and self.n * int(np.abs(x).max()) + int(np.abs(self.sums).max()) < 2**62:
            return (self.n * x - self.sums) / self.n
        return x - self.sums / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components); 0 where a component carries no direction."""
        root = np.sqrt(np.where(self.usable, self.values, 1.0))
        return np.where(self.usable, self.centred(x) @ self.components / root, 0.0)

    def deviations(self, x: np.ndarray) -> list:
        """Sum over the dimensions of (n * x - sums)^2, exact; None where it does not fit a long."""
        far = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        if far < 2**31 and x.shape[1] * far * far < 2**63:
            return ((self.n * x - self.sums) ** 2).sum(1).tolist()
        sums = [int(s) for s in self.sums]
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [e if e < 2**63 else None for e in exact]


def fit(numbers: DataFrame, n_components: int = COMPONENTS) -> Whitener | None:
    """Whitener of the distinct vectors of ``numbers`` (x array<long>, all of one length); None if there are none."""
    distinct = stored(numbers.select("x").distinct(), "distinct-vectors")
    first = distinct.agg(F.count("*"), F.max(F.size("x"))).first()
    if not first[0]:
        return None
    n, d = int(first[0]), int(first[1])
    sums = _added(distinct, d, _sums)[0]
    model = Whitener(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)

    def products(x):
        c = model.centred(x)
        return c.T @ c

    covariance = _added(distinct, d, products) / n
    covariance = (covariance + covariance.T) / 2
    model.trace = float(np.trace(covariance))
    model.values, model.components = leading_components(covariance, n_components)
    use = np.flatnonzero(model.usable)
    if len(use):
        means = _added(distinct, len(use), lambda x: model.whitened(x)[:, use].sum(0, keepdims=True))[0] / n

        def whitened_products(x):
            w = model.whitened(x)[:, use] - means
            return w.T @ w

        identity = _added(distinct, len(use), whitened_products) / n
        model.identity_error = float(np.abs(identity - np.eye(len(use))).max())
    return model


@tidy
def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding",
           n_components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    numbers = stored(whole_numbers(embeddings, key, vector), "whole-numbers")
    common = numbers.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = (f"{key} {numbers.schema[key].dataType.simpleString()}, component int, n long, deviation long, "
              "whitened double, explained double, identity_error double")
    if common is None:
        return spark.createDataFrame([], schema)
    numbers = numbers.where(F.size("x") == common["d"])
    model = fit(numbers, n_components)
    shared = spark.sparkContext.broadcast(model)           # d * (components + 2) numbers

    def run(batches):
        m = shared.value
        k = len(m.values)
        explained = m.values / m.trace if m.trace > 0 else np.zeros(k)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch.column(1))
            whitened = m.whitened(x)
            empty = np.broadcast_to(~m.usable, whitened.shape)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                 pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, m.n)),
                 pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                 pa.array(whitened.ravel(), mask=empty.ravel()),
                 pa.array(np.tile(explained, rows), mask=np.full(rows * k, m.trace <= 0)),
                 pa.array([m.identity_error] * (rows * k), pa.float64())],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return numbers.select(key, "x").mapInArrow(run, schema)
