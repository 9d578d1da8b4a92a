"""Embedding whitening by an incremental eigendecomposition.

Entries c become whole numbers x = floor(64 c) + 1000000; the fit list is each distinct vector x
once. Each partition of it holds the spectrum of its scatter matrix and takes vector after vector
as a centred rank-one update: the secular equation gives the new eigenvalues, equal values and
directions without weight are deflated, and eigenvectors come from the weights that make the
computed values exact. Spectra of partitions are combined, some at a time, by one rank-one
update per eigenpair and one for the distance of the means. A last pass over the fit list takes the
covariance in the basis found (Rayleigh-Ritz), which makes the components exact to rounding.

Bounds: a spectrum is a square matrix of the vectors' length; one is held by a task, FAN_IN by a
combining task, and one goes to all tasks.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries are left out, so
are entries beyond 2**40, and vectors of another length than most (of equally many the shortest stays);
vec_id may be null or repeat and repeated rows count once in the fit but are returned each; components
whose eigenvalue is not above 1e-12 of the largest are left out (one vector has none, and no rows);
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Shared, columns
from lodestrata.llm.components import reliable

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
FAN_IN = 8
_LARGEST = float(1 << 40)
_EPS = np.finfo(float).eps
_SPECTRUM = "part long, n long, total array<bigint>, eigenvalues array<double>, vectors array<double>"


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum(weights / (poles - t)) = 0`` as (pole nearest to each, offset from it).

    Poles rise strictly, weights are positive: one root lies behind each pole. Each step replaces
    the sums over the poles on either side by one fraction with the same value and slope, within a
    bracket that bisection narrows where the step leaves it.
    """
    k = len(poles)
    gap = np.append(np.diff(poles), weights.sum())
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + (weights[:, None] / (poles[:, None] - (poles + gap / 2))).sum(0)
        left = (middle >= 0) | (np.arange(k) == k - 1)
        near = np.arange(k) + ~left
        offsets = poles[:, None] - poles[near]
        low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
        last_left = middle[-1] >= 0
        low[-1], high[-1] = (0.0, gap[-1] / 2) if last_left else (gap[-1] / 2, gap[-1] * (1 + 4 * _EPS))
        below = np.tri(k).T  # poles up to the root's own
        above = 1 - below
        d_next = np.append(offsets[np.arange(1, k), np.arange(k - 1)], np.inf)
        d_own = offsets[np.arange(k), np.arange(k)]
        t = (low + high) / 2
        for _ in range(100):
            away = offsets - t
            part = weights[:, None] / away
            slope = part / away
            psi, phi = (part * below).sum(0), (part * above).sum(0)
            f = 1 + psi + phi
            low, high = np.where(f < 0, t, low), np.where(f >= 0, t, high)
            d1, d2 = d_own - t, d_next - t
            s, r = (slope * below).sum(0), (slope * above).sum(0)
            c = 1 + psi - s * d1 + np.where(np.isinf(d2), 0.0, phi - r * d2)
            s, r = s * d1 * d1, r * d2 * d2
            b = c * (d1 + d2) + s + r
            w = d1 * d2 * f
            root = np.sqrt(np.maximum(b * b - 4 * c * w, 0.0))
            step = np.where(b > 0, 2 * w / (b + root), (b - root) / (2 * c))
            step[-1] = d1[-1] + s[-1] / c[-1]
            new = t + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            # At an exact root, up to the rounding of the sums, no step is better than none.
            there = np.abs(f) <= 4 * _EPS * (1 + np.abs(psi) + np.abs(phi))
            t, moved = np.where(there, t, new), np.abs(new - t) > 2 * _EPS * np.abs(new)
            if not (moved & ~there).any():
                break
    return near, t


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``vectors diag(values) vectors.T + factor x x.T``, values rising."""
    z = vectors.T @ x
    size = float(z @ z)
    if size * factor == 0.0:
        return values, vectors
    rho, z = size * factor, z / np.sqrt(size)
    tolerance = 8 * _EPS * max(abs(values[0]), abs(values[-1]), rho)
    moving = rho * np.abs(z) > tolerance
    at = np.flatnonzero(moving)
    if not len(at):
        return values, vectors
    close = np.flatnonzero(np.diff(values[at]) <= tolerance)
    if len(close):
        # Values that cannot be told apart: turn their vectors so that all weight is on the last of them.
        vectors, z = vectors.copy(), z.copy()
        for k in close:
            i, j = at[k], at[k + 1]
            h = np.hypot(z[i], z[j])
            c, s = z[j] / h, z[i] / h
            vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
            z[i], z[j] = 0.0, h
        moving[at[close]] = False
        at = np.flatnonzero(moving)
    poles = values[at]
    near, t = secular_roots(poles, rho * z[at] ** 2)
    away = (poles[:, None] - poles[near]) - t  # pole i to root j
    # The weights for which the computed roots are exact.
    k = len(at)
    between = poles[:, None] - poles
    np.fill_diagonal(between, 1.0)
    ratio = np.empty((k, k))
    lower = np.tri(k, k - 1, -1, dtype=bool)  # roots before pole i are matched with their own pole, the others with the next
    ratio[:, :-1] = away[:, :-1] / np.where(lower, between[:, :-1], between[:, 1:])
    ratio[:, -1] = -away[:, -1]
    weight = np.sqrt(np.abs(ratio.prod(1))) * np.sign(z[at])
    turned = weight[:, None] / away
    turned /= np.sqrt((turned * turned).sum(0))
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[at] = poles[near] + t
    new_vectors[:, at] = vectors[:, at] @ turned
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


@dataclass
class Spectrum:
    """Number and exact sum of vectors, and the spectrum of their scatter matrix around their mean."""

    n: int
    total: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dimension: int) -> Spectrum:
        return cls(0, np.zeros(dimension, np.int64), np.zeros(dimension), np.eye(dimension))

    def add(self, x: np.ndarray) -> None:
        if self.n:
            # Exact as whole numbers, so that large means cost no digits.
            away = (self.n * x - self.total) / self.n
            self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n / (self.n + 1))
        self.n, self.total = self.n + 1, self.total + x

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.total, self.values, self.vectors = other.n, other.total, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector, value)
        away = self.total / self.n - other.total / other.n
        self.values, self.vectors = rank_one(self.values, self.vectors, away, self.n * other.n / (self.n + other.n))
        self.n, self.total = self.n + other.n, self.total + other.total

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "total": self.total.tolist(), "eigenvalues": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @classmethod
    def of(cls, row) -> Spectrum:
        d = len(row["total"])
        return cls(int(row["n"]), np.array(row["total"], np.int64), np.array(row["eigenvalues"], float), np.array(row["vectors"], float).reshape(d, d))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the usable rows; x holds whole numbers."""
    v = F.col(vector).cast("array<double>")
    usable = columns(rows, "vec_id", vector).filter(
        (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) <= F.lit(_LARGEST), F.lit(False))))  # NaN is above all numbers
    made = usable.select("vec_id", F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    lengths = made.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    return made.filter(F.size("x") == F.lit(lengths.d)) if lengths else made


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("x"))
        held = held or Spectrum.empty(x.shape[1])
        for row in x:
            held.add(row)
    if held:
        yield pa.RecordBatch.from_pylist([held.row(TaskContext.get().partitionId())], pa.schema([
            ("part", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64())), ("eigenvalues", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))]))


def _combined(spectra: list[Spectrum]) -> Spectrum:
    made = Spectrum.empty(len(spectra[0].total))
    for s in sorted(spectra, key=lambda s: -s.n):
        made.merge(s)
    return made


def _combine(key, rows: pd.DataFrame) -> pd.DataFrame:
    made = _combined([Spectrum.of(r) for r in rows.sort_values("part").to_dict("records")])
    return pd.DataFrame([made.row(int(key[0]))])


def spectrum(fit: DataFrame) -> Spectrum | None:
    """The spectrum of all vectors ``x``: one per partition, then FAN_IN at a time into one."""
    width = max(1, fit.rdd.getNumPartitions())
    spectra = reliable(fit.select("x").mapInArrow(_spectra, _SPECTRUM))
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        spectra = reliable(spectra.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(_combine, _SPECTRUM))
    found = [Spectrum.of(r) for r in spectra.orderBy("part").collect()]
    return _combined(found) if found else None


def _products(project):
    """Sums over a partition of the outer products of its projected vectors, one row per entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = project(_matrix(batch.column("x")))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])
    return run


def _covariance(fit: DataFrame, project, size: int, n: int) -> np.ndarray:
    rows = fit.select("x").mapInArrow(_products(project), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    made = np.zeros((size, size))
    for r in rows:
        made[r.i, r.j] = r.v / n
    return (made + made.T) / 2


@dataclass
class Whitening:
    n: int
    total: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.total) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sums of (n x - S)^2; in numbers of any size where 64 bits might not do."""
        away = self.n * x - self.total
        if float(np.abs(away).max(initial=0)) ** 2 * away.shape[1] >= 2.0 ** 62:
            away = away.astype(object)
        return (away * away).sum(1).tolist()


def fit_whitening(fit: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """Whitening by the first components of the distinct vectors ``x``; None without vectors."""
    found = spectrum(fit)
    if found is None:
        return None
    basis, _ = np.linalg.qr(found.vectors[:, ::-1])
    start = Whitening(found.n, found.total, np.ones(len(basis)), basis, 0.0)
    held = Shared(fit.sparkSession, start)
    inner = _covariance(fit, lambda x: held.value.whitened(x), len(basis), found.n)
    values, turns = np.linalg.eigh(inner)
    keep = np.flatnonzero(values > 1e-12 * max(values[-1], 0.0))[::-1][:most]
    components = basis @ turns[:, keep]
    components /= np.linalg.norm(components, axis=0)
    components *= np.sign(components[np.abs(components).argmax(0), np.arange(len(keep))])
    made = Whitening(found.n, found.total, values[keep], components, float(np.trace(inner)))
    if len(keep):
        final = Shared(fit.sparkSession, made)
        check = _covariance(fit, lambda x: final.value.whitened(x), len(keep), found.n)
        made.identity_error = float(np.abs(check - np.eye(len(keep))).max())
    return made


_ROWS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    usable = whole_vectors(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    made = fit_whitening(reliable(usable.select("x").distinct()), most)
    shared = Shared(rows.sparkSession, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            if fitted is None or not batch.num_rows or not len(fitted.eigenvalues):
                continue
            x, k = _matrix(batch.column("x")), len(fitted.eigenvalues)
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(len(at), fitted.n), pa.int64()), pa.array(fitted.deviation(x), pa.int64()).take(pa.array(at)),
                pa.array(fitted.whitened(x).ravel()), pa.array(np.tile(fitted.eigenvalues / fitted.trace, len(x))),
                pa.array(np.full(len(at), fitted.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.mapInArrow(run, f"vec_id {kind}, {_ROWS}")
