"""Embedding whitening with eigenvectors refined from single to double precision.

Vectors become whole numbers on a grid. Each different vector counts once (the fit list). Sums are exact;
the covariance is added up by blocks of rows as inner products of centred vectors and only its d x d
cells reach the driver. Its eigenvectors are found in float32 and corrected by the iteration of Ogita and
Aishima, a few matrix products in higher precision that double the number of right digits each time.
Pairs of eigenvalues too close to be told apart by the iteration form a cluster, whose eigenvectors are
turned by the eigenvectors of the covariance restricted to them (a small sub-solve).

Rows whose vector is null, holds null or non-finite entries or has fewer entries than the longest one
are left out. Repeated rows each give results and count once in the fit list. A null vec_id stays. A
component whose variance is rounding only (`e <= 1e-13 * trace`) cannot be whitened and is left out, so a
table with one different vector, or none, gives no rows. Other columns are not read by `whiten`. A
`deviation` that does not fit in 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scale import cut

STEP, SHIFT = 64, 1_000_000  # grid: floor(STEP * entry) + SHIFT
LIMIT = 2.0**60  # grid numbers beyond this are set to it
COMPONENTS = 16
LEAST = 1e-13  # share of the trace under which a variance is rounding
BLOCK_CELLS = 1 << 20  # entries of vectors worked on at once
ROUNDS = 40
NEAR = 1e-9  # eigenvalues closer than this share of the largest are a cluster


# eigenvectors --------------------------------------------------------------------------------------


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of eigenvalues (indices) whose neighbours are at most `gap` apart; only runs of two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _sub_solve(a: np.ndarray, x: np.ndarray, group: np.ndarray) -> None:
    """Turn the columns `group` of `x` to eigenvectors of `a` within the space that they span."""
    part = x[:, group]
    gram = part.T @ part
    part = part @ (np.eye(len(group), dtype=x.dtype) * x.dtype.type(1.5) - gram / 2)  # orthonormal again
    small = part.T @ (a @ part)
    middle = np.trace(small) / len(group)
    small = small - middle * np.eye(len(group), dtype=x.dtype)
    _, turn = np.linalg.eigh(((small + small.T) / 2).astype(np.float64))
    x[:, group] = part @ turn.astype(x.dtype)


def refined_eigenvectors(cov: np.ndarray, high: type = np.longdouble) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix.

    Starts from float32 and refines with products in `high` until nothing moves in double precision.
    """
    d = len(cov)
    if not d or not np.abs(cov).max():
        return np.zeros(d), np.eye(d)
    scale = np.abs(cov).max()
    _, start = np.linalg.eigh((cov / scale).astype(np.float32))
    a = (cov / scale).astype(high)
    x = start.astype(high)
    eye = np.eye(d, dtype=high)
    last = np.inf
    for _ in range(ROUNDS):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        width = 2 * (np.linalg.norm(off.astype(float), 2) + np.linalg.norm(s.astype(float), 2) * np.linalg.norm(r.astype(float), 2))
        width = max(width, float(np.abs(values).max()) * NEAR)
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > width
        e = np.where(apart, (s + r * values[None, :]) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ e
        moved = float(np.abs(e).max())
        for group in _clusters(values.astype(float), width):
            _sub_solve(a, x, group)
        # what still moves once the columns are orthogonal is rounding between close eigenvalues
        eps = np.finfo(np.float64).eps
        if moved < eps / 4 or (moved >= last / 2 and np.abs(r).max() < eps):
            break
        last = moved
    x = x @ (1.5 * eye - x.T @ x / 2)  # the last turns may have left second-order terms
    x = x / np.sqrt((x * x).sum(axis=0))
    values = ((x * (a @ x)).sum(axis=0) * high(scale)).astype(np.float64)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order].astype(np.float64)


# distributed passes --------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as float64, nulls as NaN."""
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def on_grid(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(STEP * values), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _usable(batch: pa.RecordBatch, column: int, d: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows with d finite entries, and these as a matrix."""
    vectors = batch.column(column)
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    batch = batch.filter(pa.array(lengths == d))
    m = _matrix(batch.column(column)) if batch.num_rows else np.zeros((0, d))
    fine = np.isfinite(m).all(axis=1)
    return batch.filter(pa.array(fine)), m[fine]


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK_CELLS // max(1, d))
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            yield batch.slice(first, step)


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """Entries of the longest vector; 0 without any."""
    return max(0, vectors.agg(F.max(F.size(F.col(column)))).head()[0] or 0)


def fit_list(vectors: DataFrame, d: int, column: str = "embedding") -> DataFrame:
    """x: each different grid vector once, as little-endian 64-bit integers.

    Copies are folded inside each partition before the exchange and no key has more rows there than
    there are partitions.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, d):
            _, m = _usable(batch, 0, d)
            x = on_grid(m)
            if len(x):
                lines = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * d), len(x), [None, pa.py_buffer(x.astype("<i8"))])
                yield pa.RecordBatch.from_arrays([lines.cast(pa.binary())], ["x"])

    return vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(work, "x binary").distinct()


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, d)


def _summed(fit: DataFrame, d: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of `part`(block of rows), a matrix of `width` columns.

    Each partition adds up its own blocks and each line of the matrix is added up by one small group.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _blocks(batches, d):
            if batch.num_rows:
                mine = part(_rows(batch, d))
                total = mine if total is None else total + mine
        if total is not None:
            lines = pa.array([line.tobytes() for line in total.astype("<f8")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lines], ["line", "cells"])

    def add(group: pa.Table) -> pa.Table:
        cells = np.frombuffer(b"".join(group.column("cells").to_pylist()), "<f8").reshape(-1, width)
        return pa.table({"line": group.column("line").slice(0, 1), "cells": pa.array([cells.sum(axis=0).tobytes()], pa.binary())})

    lines = fit.mapInArrow(work, "line int, cells binary").groupBy("line").applyInArrow(add, "line int, cells binary").collect()
    return np.stack([np.frombuffer(r["cells"], "<f8") for r in sorted(lines, key=lambda r: r["line"])])


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(number of vectors, per-dimension sums), as whole numbers of any size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in _blocks(batches, d):
            x = _rows(batch, d)
            n += len(x)
            high += (x >> 32).sum(axis=0)  # halves, so that sums of many or large numbers fit
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            at = np.arange(d + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], ["at", "high", "low"])

    sums = fit.mapInArrow(work, "at int, high long, low long").groupBy("at").agg(
        F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low")
    )
    total = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in sums.collect()}
    return total.get(d, 0), [total.get(k, 0) for k in range(d)]


@dataclass(frozen=True)
class Whitening:
    """A fitted transformation; all its parts are of the size of the dimension."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the components, falling
    vectors: np.ndarray  # d x components, unit columns
    trace: float

    @property
    def d(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n without the rounding of large means: whole part first."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)**2, exact; None where it does not fit in 64 bits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        far = np.abs(x - whole).max(initial=0)
        if self.d * (float(self.n) * (float(far) + 1)) ** 2 < 2.0**62:
            y = self.n * (x - whole) - rest
            return (y * y).sum(axis=1).tolist()
        out = []
        for line in x.tolist():
            total = sum((self.n * v - s) ** 2 for v, s in zip(line, self.sums, strict=True))
            out.append(total if total < 1 << 63 else None)
        return out


def fit(table: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a (written) fit list; None without vectors."""
    n, sums = exact_sums(table, d)
    if not n:
        return None
    base = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        y = base.centred(x)
        return y.T @ y

    cov = _summed(table, d, d, products) / n
    values, vectors = refined_eigenvectors((cov + cov.T) / 2)
    trace = float(np.trace(cov))
    good = int((values[:components] > LEAST * trace).sum()) if trace > 0 else 0
    return Whitening(n, sums, values[:good], vectors[:, :good], trace)


def identity_error(table: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity)."""
    k = len(model.values)
    if not k:
        return 0.0
    mean = _summed(table, model.d, k, lambda x: model.project(x).sum(axis=0, keepdims=True))[0] / model.n

    def products(x: np.ndarray) -> np.ndarray:
        z = model.project(x) - mean
        return z.T @ z

    return float(np.abs(_summed(table, model.d, k, products) / model.n - np.eye(k)).max())


def transform(vectors: DataFrame, model: Whitening, column: str = "embedding", out: str = "whitened") -> DataFrame:
    """`vectors` with the whitened vector (array of double) in `out`; null where the vector is not usable."""
    names = ["`" + c.replace("`", "``") + "`" for c in vectors.columns if c != out]
    if not len(model.values):
        return vectors.select(*names, F.lit(None).cast("array<double>").alias(out))
    held = vectors.select(F.struct(*names).alias("row"), F.col(column).cast("array<double>").alias("v"))
    kind = held.select("row", F.col("v").alias(out)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, model.d):
            place = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)], ["at", "v"])
            good, m = _usable(place, 1, model.d)
            z: list = [None] * batch.num_rows
            for at, line in zip(good.column(0).to_pylist(), model.project(on_grid(m)).tolist(), strict=True):
                z[at] = line
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.list_(pa.float64()))], ["row", out])

    return held.mapInArrow(work, kind).select("row.*", out)


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: its whitened coordinate and how well the fit holds."""
    spark = vectors.sparkSession
    d = dimension(vectors, column)
    table = cut(fit_list(vectors, d, column), "fit-list") if d else None
    model = fit(table, d, components) if d else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], OUT)
    error = identity_error(table, model)
    k = len(model.values)
    explained = model.values / model.trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, d):
            batch, m = _usable(batch, 1, d)
            rows = len(m)
            if not rows:
                continue
            x = on_grid(m)
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)),
                    pa.array(model.deviation(x), pa.int64()).take(each),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                [c.split()[0] for c in OUT.split(", ")],
            )

    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    return source.mapInArrow(work, OUT)
