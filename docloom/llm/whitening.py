"""Whitening of embeddings by the eigenvectors of their covariance.

Each partition streams its vectors through Welford's updates: a count, exact integer sums, a mean, and centred products
that grow by one rank-one matrix a vector. The states of partitions are merged by the parallel update formula, in tasks,
``FAN`` at a time, until few enough are left for the driver, so what reaches it never depends on the number of
partitions. The covariance (divisor n) is reduced to a tridiagonal matrix by reflections and diagonalised by implicit
QR steps with Wilkinson's shift. A second stream whitens and measures the covariance of what it has whitened.

Entries become floor(scale x) + shift exactly; what lies beyond 2**52 counts as that.

Edge cases: null vectors and those with null or non-finite entries take no part; shorter vectors count as padded with
zero entries; rows of null or equal ids are vectors like others; a component whose eigenvalue is nothing beside the
trace (fewer rows than components, equal rows) has null for ``whitened`` and takes no part in the error; a deviation
beyond 64 bits is null; an empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: States that are merged by one task; entries larger than this are clipped; eigenvalues below this share of the trace are none.
FAN, LARGEST, NOTHING = 64, 2**52, 1e-13


class Moments:
    """Count, exact sums, mean and centred products of vectors."""

    def __init__(self, width: int) -> None:
        self.n, self.sums, self.mean, self.products = 0, [0] * width, np.zeros(width), np.zeros((width, width))

    def add(self, x: np.ndarray) -> None:
        """Rows, one after another."""
        for row in x:
            self.n += 1
            off = row - self.mean
            self.mean += off / self.n
            self.products += np.outer(off * ((self.n - 1) / self.n), off)
        if x.dtype == np.int64:
            small = int(np.abs(x).max(initial=0)) * len(x) < 2**62
            self.sums = [a + int(b) for a, b in zip(self.sums, x.sum(axis=0, dtype="int64" if small else object), strict=True)]

    def merge(self, other: Moments) -> Moments:
        if other.n:
            n, off = self.n + other.n, other.mean - self.mean
            self.products += other.products + np.outer(off * (self.n / n * other.n), off)
            self.mean += off * (other.n / n)
            self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return self

    def covariance(self) -> np.ndarray:
        return self.products / self.n

    STATE = "slot long, n long, sums array<string>, mean array<double>, products array<double>"

    def row(self, slot: int) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        values = (slot, self.n, [str(s) for s in self.sums], self.mean, self.products.ravel())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["slot", "n", "sums", "mean", "products"])

    @classmethod
    def of(cls, n: int, sums: list[str], mean: list[float], products: list[float]) -> Moments:
        m = cls(len(mean))
        m.n, m.sums, m.mean = n, [int(s) for s in sums], np.array(mean)
        m.products = np.array(products).reshape(len(mean), len(mean))
        return m


def merged(states: DataFrame, width: int) -> Moments:
    """One state of all; tasks merge ``FAN`` neighbours at a time while there are more."""
    states = cut(states)

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["was"])
        one = Moments(width)
        for r in rows:
            one.merge(Moments.of(r["n"], r["sums"], r["mean"], r["products"]))
        return pa.Table.from_batches([one.row(rows[0]["slot"])])

    while states.count() > FAN:
        up = states.withColumn("was", F.col("slot")).withColumn("slot", F.floor(F.col("slot") / FAN).cast("long"))
        states = cut(up.groupBy("slot").applyInArrow(run, Moments.STATE))
    one = Moments(width)
    for r in sorted(states.collect(), key=lambda r: r["slot"]):
        one.merge(Moments.of(r["n"], r["sums"], r["mean"], r["products"]))
    return one


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A symmetric matrix -> diagonal, the one beside it, and the orthogonal q of a = q t q'."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        if size := np.linalg.norm(v):
            v /= size
            a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
            q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; of each vector the largest entry is positive."""
    d, e, q = tridiagonal(a)
    eps, high = np.finfo(float).eps, len(d) - 1

    def negligible(k: int) -> bool:
        return abs(e[k]) <= eps * (abs(d[k]) + abs(d[k + 1]))

    while high > 0:
        if negligible(high - 1):
            high -= 1
            continue
        low = high - 1
        while low and not negligible(low - 1):
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, t, m = d[k], d[k + 1], e[k]
            d[k], d[k + 1], e[k] = c * c * p + 2 * c * s * m + s * s * t, s * s * p - 2 * c * s * m + c * c * t, c * s * (t - p) + (c * c - s * s) * m
            x = e[k]
            if k < high - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[:, k], q[:, k + 1] = c * q[:, k] + s * q[:, k + 1], c * q[:, k + 1] - s * q[:, k]
    order = np.argsort(-d, kind="stable")
    q = q[:, order]
    signs = np.sign(q[np.abs(q).argmax(axis=0), np.arange(len(d))]) if len(d) else 1
    return d[order], q * signs


def _integers(column: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    """Lists of doubles -> rows of floor(scale c) + shift."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), "float64")
    c = np.zeros((len(column), width))
    c[np.arange(width)[None] < sizes[:, None]] = flat
    return np.clip(np.floor(c * scale), -LARGEST, LARGEST).astype("int64") + shift


def _usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    e = F.col(embedding)
    fine = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(fine).select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("e"))


def deviations(off: np.ndarray) -> list[int | None]:
    """Sums of squares of rows of integers, exact; null beyond 64 bits."""
    if off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2**62:
        return (off * off).sum(axis=1).tolist()
    sums = [sum(int(x) ** 2 for x in row) for row in off]
    return [s if s < 2**63 else None for s in sums]


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error: a row a vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = _usable(rows, vec_id, embedding)
    width = vectors.agg(F.max(F.size("e"))).first()[0]
    if not width:
        return rows.sparkSession.createDataFrame([], schema)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(width)
        for b in batches:
            m.add(_integers(b.column(0), width, scale, shift))
        if m.n:
            yield m.row(TaskContext.get().partitionId())

    all_of = merged(vectors.select("e").mapInArrow(fit, Moments.STATE), width)
    n, sums, v = all_of.n, np.array(all_of.sums, object), all_of.covariance()
    values, basis = symmetric_qr(v)
    values, basis = values[:components], basis[:, :components]
    trace = float(np.trace(v))
    live = values > NOTHING * trace
    roots = np.sqrt(np.where(live, values, 1))
    fits = max(map(abs, all_of.sums)) < 2**61

    def project(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = _integers(column, width, scale, shift)
        if fits and int(np.abs(x).max(initial=0)) * n < 2**61:
            off = x * n - sums.astype("int64")
        else:
            off = x.astype(object) * n - sums
        return off, (off / n).astype("float64") @ basis / roots

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Moments(len(values))
        for b in batches:
            m.add(project(b.column(0))[1])
        if m.n:
            yield m.row(TaskContext.get().partitionId())

    seen = merged(vectors.select("e").mapInArrow(measure, Moments.STATE), len(values)).covariance()
    error = float(np.abs(seen - np.eye(len(values)))[np.ix_(live, live)].max()) if live.any() else None
    shares = [float(x) / trace if trace else None for x in values]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, white = project(b.column(1))
            k, rows = len(values), b.num_rows
            arrays = [
                b.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), rows)),
                pa.array(np.full(rows * k, n, "int64")),
                pa.array(np.repeat(np.array(deviations(off), object), k).tolist(), pa.int64()),
                pa.array(white.ravel(), mask=np.tile(~live, rows)),
                pa.array(shares * rows, pa.float64()),
                pa.array([error] * (rows * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(out, schema)


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
