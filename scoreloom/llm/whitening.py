"""Embedding whitening: streamed covariance, symmetric QR, and coordinates of unit variance.

Entries become x = floor(64 c) + 1000000 as whole numbers. Each task streams its rows through
Welford's rank-one updates (count, mean, centred products), so nothing is held but one state of
d * d numbers; the states of all tasks meet pairwise by the parallel update formula, ``FAN`` to a
task and level after level, until one is left. The driver gets that one state. It brings the
covariance to tridiagonal form by Householder reflections and then to its eigenvalues by
implicit symmetric QR steps with Wilkinson's shift. Rows are projected on the leading
eigenvectors over the root of their eigenvalues.

The sums of x are kept apart as whole numbers of any size, so deviations from the mean are exact.
The covariance of the whitened coordinates comes from a second streamed pass over all rows, by
the same updates; its distance from the identity is reported with each row.

Plan: a narrow count of lengths, two streamed passes that send one state a task, one that
writes. No shuffle of rows, no key, hence no skew; a lost task is run again.

Defined cases: a vector that is null, or has a null or non-finite entry or one of 2^46 and
more, takes no part; of vectors of different length the most frequent length takes part (ties:
the greater); rows of a null id take part and keep it; repeated rows count each; directions
whose variance is below ``RANK`` of the greatest have no component, so equal vectors, a single
one or an empty table give no rows; a deviation beyond 64 bits is null; further columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import quoted

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Entries from here on are no longer whole doubles behind the scale.
LARGE = 2.0**46
#: States that one task merges.
FAN = 16
RANK = 1e-12
#: Vectors of an output batch.
BLOCK = 2048
STATE = "n long, sums string, mean binary, products binary"
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Moments:
    """Count, whole sums, mean and centred products of the rows seen so far."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean, self.products = 0, [0] * d, np.zeros(d), np.zeros((d, d))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update, row by row."""
        mean, products, buffer = self.mean, self.products, np.empty_like(self.products)
        for row in rows:
            self.n += 1
            delta = row - mean
            np.multiply.outer(delta, delta * ((self.n - 1) / self.n), out=buffer)
            products += buffer
            mean += delta / self.n

    def add_whole(self, x: np.ndarray) -> None:
        high, low = (x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)
        self.sums = [s + (h << 26) + b for s, h, b in zip(self.sums, high.tolist(), low.tolist())]

    def merge(self, other: Moments) -> None:
        if not other.n:
            return
        n, delta = self.n + other.n, other.mean - self.mean
        self.products += other.products + np.multiply.outer(delta, delta) * (self.n * other.n / n)
        self.mean += delta * (other.n / n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.n = n

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)

    def batch(self) -> pa.RecordBatch:
        row = [self.n, ",".join(map(str, self.sums)), self.mean.tobytes(), self.products.tobytes()]
        types = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["n", "sums", "mean", "products"])

    @staticmethod
    def of(n: int, sums: str, mean: bytes, products: bytes) -> Moments:
        center = np.frombuffer(mean).copy()
        out = Moments(len(center))
        out.n, out.mean = n, center
        out.sums = [int(s) for s in sums.split(",")] if sums else []
        out.products = np.frombuffer(products).reshape(len(center), len(center)).copy()
        return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(4))):
            state = Moments.of(*(v.as_py() for v in row))
            if total is None:
                total = state
            else:
                total.merge(state)
    if total is not None:
        yield total.batch()


def gathered(states: DataFrame, d: int) -> Moments:
    """All states merged, ``FAN`` to a task."""
    parts = states.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN)
        states = states.repartition(parts).mapInArrow(_merge, STATE)
    total = Moments(d)
    for row in states.collect():  # one
        total.merge(Moments.of(row["n"], row["sums"], bytes(row["mean"]), bytes(row["products"])))
    return total


def whole(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column of equal lengths as whole numbers x."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * values).astype(np.int64) + OFFSET


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: of 64 bits where they suffice, else of Python's numbers."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, None beyond 64 bits."""
    most = int(np.abs(y).max(initial=0))
    if y.shape[1] * most * most < 2**63:
        return (y.astype(np.int64) ** 2).sum(axis=1).tolist()
    sums = (int((r * r).sum()) for r in y.astype(object))
    return [s if s < 2**63 else None for s in sums]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q of Q' a Q = T, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.abs(v).max()
        if size == 0 or not v[1:].any():
            continue
        v /= size
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (as columns) of a symmetric matrix."""
    d, e, q = tridiagonal(a)
    rows = np.ascontiguousarray(q.T)  # a rotation of two columns of Q
    eps, hi, least = np.finfo(float).eps, len(d) - 1, 1e-30 * np.abs(a).max()
    while hi > 0:
        near = least + eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[np.abs(e) <= near] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo and e[lo - 1] != 0:
            lo -= 1
        half, b = (d[hi - 1] - d[hi]) / 2, e[hi - 1]
        shift = d[hi] - b * (b / (half + math.copysign(math.hypot(half, b), half)))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dl, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dl, s * s * dk - 2 * c * s * ek + c * c * dl
            e[k] = c * s * (dl - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            rows[k], rows[k + 1] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    order = np.argsort(-d, kind="stable")
    return d[order], rows[order].T


def whiten_vectors(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each remaining row and component."""
    rows = vectors.select(F.col(quoted(vec_id)).cast("long").alias("vec_id"), F.col(quoted(vector)).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(LARGE))))
    none = vectors.sparkSession.createDataFrame([], SCHEMA)
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None or not length["d"]:
        return none
    d = length["d"]
    fit = rows.where(F.size("v") == d)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(d)
        for batch in batches:
            x = whole(batch.column(0), d)
            state.add_whole(x)
            state.add(x.astype(float))
        if state.n:
            yield state.batch()

    total = gathered(fit.select("v").mapInArrow(moments, STATE), d)
    n, sums, covariance = total.n, total.sums, total.covariance()
    values, axes = symmetric_qr(covariance)
    k = min(components, int((values > RANK * max(values[0], 0)).sum()))
    if k <= 0:
        return none
    explained, project = values[:k] / np.trace(covariance), axes[:, :k] / np.sqrt(values[:k])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments(k)
        for batch in batches:
            state.add(deviations(whole(batch.column(0), d), n, sums).astype(float) / n @ project)
        if state.n:
            yield state.batch()

    error = float(np.abs(gathered(fit.select("v").mapInArrow(spread, STATE), k).covariance() - np.eye(k)).max())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                y, m = deviations(whole(part.column(1), d), n, sums), part.num_rows
                places = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column(0).take(places),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(squared(y), pa.int64()).take(places),
                    pa.array((y.astype(float) / n @ project).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return fit.mapInArrow(write, SCHEMA)
