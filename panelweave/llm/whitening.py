"""Whitening of embeddings by an incremental eigendecomposition.

Every task keeps the spectrum of the rows it has seen and changes it by centred
rank-one updates, each of which solves a secular equation after deflation. The
tasks' spectra meet in a tree: one takes up the eigenpairs of the other, and
the difference of the means, by successive rank-one updates. A last pass over
all rows projects the covariance on the basis so found (Rayleigh-Ritz), which
brings values and vectors to double precision.

A block of rows is first replaced by the triangle of its QR factorisation,
which has the same scatter, so that a block costs as many updates as there are
dimensions and not as there are rows.

Edge cases: a vector that is null, empty, holds null or non-finite entries or
is of another length than most valid ones (of two lengths equally frequent, the
larger counts) is left out. Entries beyond 64 bits are set to the nearest that
fits. Repeated rows give repeated results, and their vector counts once in the
fit. An empty table gives no rows. A component without variance has a null
``whitened`` and 0 explained; ``deviation`` is null where it exceeds 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import materialize, ship

SCALE, COMPONENTS, BLOCK, FAN, BATCH_ENTRIES = 256, 4, 1024, 8, 1 << 19
EPS = float(np.finfo(np.float64).eps)
SPECTRUM = "part long, n long, sums binary, values binary, vectors binary"
SUM = "part long, total binary"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum(z² / (d - x)) for ascending, distinct ``d`` and ``z`` without zeros.

    Each root is given as the pole next to it and the distance from there, so
    that its differences to all poles keep their digits. Rational interpolation
    with a pole on either side, bisecting where it leaves the bracket.
    """
    k = len(d)
    w = z * z
    at = np.arange(k)
    gap = np.append(np.diff(d), w.sum())
    middle = 1 + (w / (d - d[:, None] - gap[:, None] / 2)).sum(1)
    right = (middle < 0) & (at < k - 1)
    origin = at + right
    delta = d - d[origin][:, None]
    ends = np.append(d[1:] - d[origin[:-1]], gap[-1])
    lo, hi = np.where(right, -gap / 2, 0), np.where(right, 0, np.where(at < k - 1, gap / 2, gap))
    tau, left = (lo + hi) / 2, np.tril(np.ones((k, k), bool))
    with np.errstate(all="ignore"):
        for _ in range(200):
            far = delta - tau[:, None]
            term = w / far
            f = 1 + term.sum(1)
            done = (np.abs(f) <= EPS * k * (1 + np.abs(term).sum(1))) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if done.all():
                break
            lo, hi = np.where(f < 0, tau, lo), np.where(f < 0, hi, tau)
            slope = term / far
            below, above = np.where(left, slope, 0).sum(1), np.where(left, 0, slope).sum(1)
            one, two = far[at, at], ends - tau
            a, b, c = (one + two) * f - one * two * (below + above), one * two * f, f - one * below - two * above
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = tau + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            tau = np.where(done, tau, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
    return origin, tau


def solved(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + zz'; the vectors are orthogonal as ``z`` is recomputed from the roots."""
    k = len(d)
    if k == 1:
        return d + z * z, np.ones((1, 1))
    origin, tau = secular(d, z)
    far = d - d[origin][:, None] - tau[:, None]
    i, j = np.arange(k), np.arange(k)[:, None]
    # root j goes with pole j for the poles after it and with pole j + 1 for the others; the last root stands alone
    poles = np.where(j < i, d[:, None] - d, np.append(d[1:], 0)[:, None] - d)
    poles[-1] = 1
    fresh = np.sign(z) * np.sqrt(np.abs(np.prod(-far / poles, axis=0)))
    vectors = fresh[:, None] / far.T
    return d[origin] + tau, vectors / np.linalg.norm(vectors, axis=0)


def updated(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of A + vv', from the ascending values and the columns of A's spectrum; directions without variance have no column."""
    size = float(np.linalg.norm(v))
    if not size:
        return values, vectors
    z = vectors.T @ v
    rest = v - vectors @ z
    again = vectors.T @ rest
    rest, z = rest - vectors @ again, z + again
    new = float(np.linalg.norm(rest))
    if len(values) < len(v) and new > 64 * EPS * size:
        values, z = np.append(0.0, values), np.append(new, z)
        vectors = np.column_stack((rest / new, vectors))
    else:
        vectors = vectors.copy()
    values = values.copy()
    tol = 8 * EPS * max(float(values[-1]) if len(values) else 0.0, size * size)
    live = np.flatnonzero(np.abs(z) * size > tol)
    if len(live) > 1:
        p, q = z[live[:-1]], z[live[1:]]
        if (np.diff(values[live]) * np.abs(p * q) <= tol * (p * p + q * q)).any():
            kept, last = [], live[0]
            for k in live[1:]:
                both = float(np.hypot(z[last], z[k]))
                c, s = z[k] / both, z[last] / both
                if abs((values[k] - values[last]) * c * s) <= tol:  # turn the pair so that one of them has no part in v
                    a, b = vectors[:, last].copy(), vectors[:, k].copy()
                    vectors[:, last], vectors[:, k] = c * a - s * b, s * a + c * b
                    values[last], values[k] = values[last] * c * c + values[k] * s * s, values[last] * s * s + values[k] * c * c
                    z[last], z[k] = 0.0, both
                else:
                    kept.append(last)
                last = k
            live = np.array([*kept, last])
    if len(live):
        order = live[np.argsort(values[live], kind="stable")]
        values[order], turn = solved(values[order], z[order])
        vectors[:, order] = vectors[:, order] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Rows seen, their exact sums, and the spectrum of their scatter about their mean."""

    dims: int
    n: int = 0
    sums: np.ndarray = field(default=None)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.sums = np.array([0] * self.dims, object) if self.sums is None else self.sums
        self.vectors = np.zeros((self.dims, 0)) if self.vectors is None else self.vectors

    def mean(self) -> np.ndarray:
        return (self.sums / self.n).astype(np.float64)

    def change(self, v: np.ndarray) -> None:
        self.values, self.vectors = updated(self.values, self.vectors, v)

    def meet(self, n: int, sums: np.ndarray, parts: np.ndarray) -> None:
        """Takes up ``n`` rows with these sums whose scatter is that of the rows of ``parts``."""
        if self.n:
            self.change((self.mean() - (sums / n).astype(np.float64)) * np.sqrt(self.n / (self.n + n) * n))
        self.n, self.sums = self.n + n, self.sums + sums
        for v in parts:
            self.change(v)

    def add(self, x: np.ndarray) -> None:
        """Takes up a block of rows of whole numbers."""
        sums = exact_sums(x)
        centred = x - (sums / len(x)).astype(np.float64)
        self.meet(len(x), sums, np.linalg.qr(centred, mode="r") if len(x) > self.dims else centred)

    def merge(self, other: Spectrum) -> None:
        self.meet(other.n, other.sums, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": ",".join(map(str, self.sums)).encode(), "values": self.values.tobytes(), "vectors": self.vectors.tobytes()}

    @classmethod
    def of(cls, row) -> Spectrum:
        sums = np.array([int(x) for x in bytes(row["sums"]).split(b",")], object)
        values = np.frombuffer(row["values"])
        return cls(len(sums), int(row["n"]), sums, values, np.frombuffer(row["vectors"]).reshape(len(sums), len(values)))


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python integers, which don't overflow."""
    return (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's length, whether it has entries and all are finite, and all entries."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    bad, ends = np.append(0, np.cumsum(~np.isfinite(flat))), np.cumsum(lengths)
    return lengths, (lengths > 0) & (bad[ends] == bad[ends - lengths]), flat


def quantised(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors remain, and their entries as whole numbers."""
    lengths, ok, flat = vectors_of(column)
    take = ok & (lengths == dims)
    x = np.floor(SCALE * flat[np.repeat(take, lengths)].reshape(-1, dims))
    inside = np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)
    return take, np.where(x >= 2.0**63, np.iinfo(np.int64).max, np.where(x < -(2.0**63), np.iinfo(np.int64).min, inside))


def slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds a bounded number of entries."""
    step = max(1, BATCH_ENTRIES // max(dims, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, ok, _ = vectors_of(batch.column(0))
        size, n = np.unique(lengths[ok], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(n)], names=["dims", "n"])


def _quantise(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, dims):
        _, x = quantised(batch.column(0), dims)
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])


def fit_rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in slices(batches, dims):
        if batch.num_rows:
            yield np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, dims)


def _spectrum(batches: Iterator[pa.RecordBatch], dims: int, block: int) -> Iterator[pa.RecordBatch]:
    seen = Spectrum(dims)
    for x in fit_rows(batches, dims):
        for at in range(0, len(x), block):
            seen.add(x[at : at + block])
    if seen.n:
        yield pa.RecordBatch.from_pylist([seen.row(TaskContext.get().partitionId())], pa.schema([("part", pa.int64()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("sums", "values", "vectors")]]))


def _project(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the projected rows and of their products, row by row of the upper matrix."""
    total = np.zeros((basis.shape[1] + 1, basis.shape[1]))
    for x in fit_rows(batches, len(basis)):
        y = (differences(x, n, sums) / n).astype(np.float64) @ basis
        total[0] += y.sum(0)
        total[1:] += y.T @ y
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])


def differences(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact."""
    top = int(np.abs(x.astype(np.float64)).max(initial=0)) * n + max(map(abs, sums), default=0)
    return x * n - sums.astype(np.int64) if top < 1 << 62 else x.astype(object) * n - sums


def deviations(far: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exact; null where they exceed 64 bits."""
    if far.dtype != object and float(np.abs(far).max(initial=0)) ** 2 * far.shape[1] < 2.0**62:
        return (far * far).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in r) for r in far)]


def tree(parts: DataFrame, schema: str, merge: Callable[[list[dict], int], dict], label: str) -> dict | None:
    """Merges the rows of tasks, ``FAN`` at a time in order, until one is left, which comes to the driver."""
    parts = materialize(parts, label)
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while n > 1:
        one = lambda key, rows: pd.DataFrame([merge(rows.sort_values("part").to_dict("records"), int(key[0]))])
        parts = materialize(parts.groupBy(F.expr(f"part div {FAN}").alias("up")).applyInPandas(one, schema), label)
        n = -(-n // FAN)
    return next((r.asDict() for r in parts.collect()), None)


def _merge_spectra(rows: list[dict], part: int) -> dict:
    first = Spectrum.of(rows[0])
    for row in rows[1:]:
        first.merge(Spectrum.of(row))
    return first.row(part)


def _merge_sums(rows: list[dict], part: int) -> dict:
    return {"part": part, "total": np.sum([np.frombuffer(r["total"]) for r in rows], axis=0).tobytes()}


@dataclass(frozen=True)
class Whitening:
    """The fitted transform: ``components`` are unit columns, ``values`` their variances, falling."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def whiten(self, far: np.ndarray) -> np.ndarray:
        """Whitened rows from ``differences``; NaN for a component without variance."""
        with np.errstate(all="ignore"):
            return np.where(self.values > 0, ((far / self.n).astype(np.float64) @ self.components) / np.sqrt(self.values), np.nan)


def moments(fit: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance of the fit list's rows projected on ``basis``, centred before they are multiplied."""
    found = tree(fit.mapInArrow(partial(_project, n=n, sums=sums, basis=basis), SUM), SUM, _merge_sums, "products")
    total = np.frombuffer(found["total"]).reshape(-1, basis.shape[1]) / n
    return total[1:] - np.outer(total[0], total[0])


def fit(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """Fits on each distinct quantised vector once; None if there is none."""
    spark = embeddings.sparkSession
    ship(spark)
    vectors = embeddings.select(F.col(column).cast("array<double>").alias("embedding"))
    top = vectors.mapInArrow(_lengths, "dims long, n long").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if top is None:
        return None
    dims = top["dims"]
    # equal vectors meet after each task has dropped its own repeats
    rows = materialize(vectors.mapInArrow(partial(_quantise, dims=dims), "x binary").distinct(), "fit-list")
    found = Spectrum.of(tree(rows.mapInArrow(partial(_spectrum, dims=dims, block=block), SPECTRUM), SPECTRUM, _merge_spectra, "spectra"))
    k = min(components, dims)
    basis = found.vectors if len(found.values) else np.eye(dims, 1)
    values, turn = np.linalg.eigh(moments(rows, found.n, found.sums, basis))
    values, turn = np.maximum(values[::-1], 0), turn[:, ::-1]
    trace = float(values.sum())
    values = np.where(values > 8 * EPS * dims * values[0], values, 0)[:k]
    chosen = np.zeros((dims, k))
    chosen[:, : len(values)] = basis @ turn[:, :k]
    values = np.append(values, np.zeros(k - len(values)))
    live = values > 0
    error = 0.0
    if live.any():
        scaled = chosen[:, live] / np.sqrt(values[live])
        error = float(np.abs(moments(rows, found.n, found.sums, scaled) - np.eye(int(live.sum()))).max())
    return Whitening(found.n, found.sums, chosen, values, trace, error)


def _transform(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, len(model.sums)):
        take, x = quantised(batch.column(1), len(model.sums))
        far = differences(x, model.n, model.sums)
        white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(model.values), pa.int32()), pa.array(model.whiten(far).reshape(-1), pa.float64(), from_pandas=True))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(take)), pa.array(deviations(far), pa.int64()), white], names=["vec_id", "deviation", "whitened"])


def transform(embeddings: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key``, the exact deviation and the whitened vector of every remaining row."""
    kind = embeddings.schema[key].dataType.simpleString()
    result = f"vec_id {kind}, deviation long, whitened array<double>"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], result)
    rows = embeddings.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    return rows.mapInArrow(partial(_transform, model=model), result)


def report(embeddings: DataFrame) -> DataFrame:
    """A row for each remaining vector and component, with the fit's figures."""
    model = fit(embeddings)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values])
    rows = transform(embeddings, model).select(F.col("vec_id").cast("long"), "deviation", F.posexplode("whitened").alias("at", "white"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("white").alias("whitened"), F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
