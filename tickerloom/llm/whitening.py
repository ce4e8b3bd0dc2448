"""Whitening of embeddings: blockwise QR, Householder bidiagonals, dqds singular values, twisted factorisations.

1. Tasks reduce their centred rows to triangular factors, which further tasks stack and reduce again, so no covariance matrix
   is ever formed and no digits are lost to squares.
2. The last factor, as large as the dimension squared whatever the number of rows, is made bidiagonal by Householder
   reflections. The differential qd algorithm with shifts finds all its singular values to high relative accuracy.
3. The eigenvector of a singular value comes from the twisted factorisation whose twist has the smallest pivot. Vectors of
   close values are improved by inverse iteration and made orthogonal among themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Entries from here on have no place in a long after scaling.
LARGEST = float(1 << 56)
#: Triangular factors that one task stacks.
FAN = 16
#: Eigenvalues nearer than this, relative to the larger, have their vectors made orthogonal by hand.
CLOSE = 1e-3
_EPS = float(np.finfo(float).eps)


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows ``key, x`` of all usable vectors, x as longs, and their dimension.

    Left out are null vectors, those with null, non-finite or unscalable entries (2^56 and more), and those of another length
    than the most frequent one (of equally frequent ones the longest). Repeated rows count as often as they stand.
    """
    c = F.col(f"`{vector}`")
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) >= LARGEST))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + OFFSET)
    rows = df.where(c.isNotNull()).where(~odd).select(F.col(f"`{key}`").alias("key"), x.alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.where(F.size("x") == d), d


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _fits(*factors: int) -> bool:
    return math.prod(map(int, factors)) < 1 << 62


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for batch in batches:
            x = _matrix(batch, d)
            if len(x):
                part = x.sum(0) if _fits(np.abs(x).max(), len(x)) else x.astype(object).sum(0)
                total = [a + int(b) for a, b in zip(total, part)]
                n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38)), pa.array([n] * d, pa.int64())], ["at", "total", "n"])

    found = rows.select("x").mapInArrow(add, "at int, total decimal(38,0), n long").groupBy("at").agg(
        F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()  # a row per dimension
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly: as longs where they hold it, else as whole numbers of any size."""
    if _fits(n, np.abs(x).max(initial=1), 2):
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def triangle(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of a QR factorisation of all centred rows, by a tree of tasks."""
    d = len(total)

    def rows_first(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        step = max(1, (1 << 20) // d)
        for batch in batches:
            x = _matrix(batch, d)
            for k in range(0, len(x), step):
                yield _centred(x[k : k + step], n, total).astype(float) / n

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for r in batch.column("r").to_pylist():
                yield np.frombuffer(r).reshape(-1, d)

    def reduce(blocks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for block in blocks(batches):
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()] if r.size else [], pa.binary())], ["r"])

    parts, level = rows.rdd.getNumPartitions(), rows.select("x").mapInArrow(partial(reduce, rows_first), "r binary")
    while parts > 1:
        parts = -(-parts // FAN)
        level = level.repartition(parts).mapInArrow(partial(reduce, stacked), "r binary")
    last = [np.frombuffer(bytes(r["r"])).reshape(-1, d) for r in level.collect()]  # one row, of the dimension squared
    r = np.zeros((d, d))
    for block in last:
        r[: len(block)] = block
    return r


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of a bidiagonal matrix, and the reflections of the columns that lead to it."""
    a, d, right = r.astype(float).copy(), len(r), []

    def reflection(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        scale = np.abs(v).max(initial=0.0)
        if scale == 0:
            return v
        v /= scale
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 1 < d:
            v = reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling, by differential qd steps with shifts.

    A step without shift yields the diagonal of the inverse, whose trace bounds the least value from below; that bound is the
    next shift, so every quantity stays positive and is found to high relative accuracy.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    least = (_EPS * _EPS) ** 2
    q = np.maximum((diagonal / scale) ** 2, least).tolist()
    e = ((above / scale) ** 2).tolist()
    found: list[float] = []
    parts = [(q, e, 0.0)]
    while parts:
        q, e, shifted = parts.pop()
        while q:
            n = len(q)
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= _EPS * _EPS * (shifted + min(q[k], q[k + 1])) or e[k] < 1e-290), None)
            if n == 1 or cut == n - 2:
                found.append(shifted + q.pop())
                e = e[: n - 2]
                continue
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], shifted))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            q, e, d = _qd_step(q, e, 0.0)
            if min(d) <= 0:
                q = [max(x, least) for x in q]
                continue
            shift = (1 - 4 * n * _EPS) / sum(1 / x for x in d)
            again = _qd_step(q, e, shift)
            if min(again[2]) > 0:
                q, e, shifted = again[0], again[1], shifted + shift
    return np.sort(np.array(found))[::-1] * scale**2


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    d, q2, e2, ds = q[0] - shift, [], [], []
    for k in range(len(e)):
        ds.append(d)
        new = d + e[k]
        ratio = q[k + 1] / new if new else math.inf
        q2.append(new)
        e2.append(e[k] * ratio)
        d = d * ratio - shift
    ds.append(d)
    return [*q2, d], e2, ds


class Twisted:
    """Factorisation of B'B - value that starts from both ends and meets at the row of the smallest pivot."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float, tiny: float):
        a, b, n = diagonal.tolist(), above.tolist(), len(diagonal)
        d = [x * x for x in a]
        dl = [a[i] * b[i] for i in range(n - 1)]
        dll = [b[i] * b[i] for i in range(n - 1)]
        safe = lambda x: x if abs(x) > tiny else math.copysign(tiny, x)
        self.top, self.low, s, down = [0.0] * n, [0.0] * n, -value, []
        for i in range(n):
            down.append(s)
            self.top[i] = safe(d[i] + s)
            if i < n - 1:
                self.low[i] = dl[i] / self.top[i]
                s = s * dll[i] / self.top[i] - value
        self.bottom, self.high, p, up = [0.0] * n, [0.0] * n, d[n - 1] - value, [0.0] * n
        up[n - 1] = p
        for i in range(n - 2, -1, -1):
            self.bottom[i + 1] = safe(dll[i] + p)
            self.high[i] = dl[i] / self.bottom[i + 1]
            p = p * d[i] / self.bottom[i + 1] - value
            up[i] = p
        pivots = [down[i] + up[i] + value for i in range(n)]
        self.twist = min(range(n), key=lambda i: abs(pivots[i]))
        self.pivot, self.n = safe(pivots[self.twist]), n

    def vector(self) -> np.ndarray:
        z, k = [0.0] * self.n, self.twist
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -self.low[i] * z[i + 1]
        for i in range(k, self.n - 1):
            z[i + 1] = -self.high[i] * z[i]
        out = np.array(z)
        return out / np.linalg.norm(out)

    def solve(self, v: np.ndarray) -> np.ndarray:
        y, k, n = v.tolist(), self.twist, self.n
        for i in range(1, k + 1):
            y[i] -= self.low[i - 1] * y[i - 1]
        for i in range(n - 2, k - 1, -1):
            y[i] -= self.high[i] * y[i + 1]
        y[k] /= self.pivot
        for i in range(k - 1, -1, -1):
            y[i] = y[i] / self.top[i] - self.low[i] * y[i + 1]
        for i in range(k + 1, n):
            y[i] = y[i] / self.bottom[i] - self.high[i - 1] * y[i - 1]
        out = np.array(y)
        return out / np.linalg.norm(out)


def eigenvectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Unit eigenvectors of B'B for its ``count`` largest values, as columns."""
    n, out = len(diagonal), np.zeros((len(diagonal), count))
    tiny = max(values[0], 1e-290) * _EPS * _EPS
    first = 0
    for j in range(count):
        if j and values[j - 1] - values[j] > CLOSE * values[j - 1]:
            first = j
        nudged = values[j] * (1 - 2 * _EPS * (j - first))
        split = Twisted(diagonal, above, float(nudged), tiny)
        z = split.vector()
        crowd = out[:, first:j]
        close = j > first or j + 1 < n and values[j] - values[j + 1] <= CLOSE * values[j]
        for turn in range(4 if close else 1):
            if crowd.shape[1]:
                for _ in range(2):
                    z = z - crowd @ (crowd.T @ z)
                if np.linalg.norm(z) < 0.1 and turn < 3:  # the twist leads to a vector that is there already
                    z = np.random.default_rng(j + 1000 * turn).standard_normal(n)
                    z -= crowd @ (crowd.T @ z)
                z = z / np.linalg.norm(z)
            z = split.solve(z)
        if crowd.shape[1]:
            for _ in range(2):
                z = z - crowd @ (crowd.T @ z)
        out[:, j] = z / np.linalg.norm(z)
    return out


def components(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of R, falling, and the right singular vectors of the ``count`` largest as columns."""
    a, b, right = bidiagonal(r)
    values = dqds(a, b)
    vectors = eigenvectors(a, b, values, count)
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    return values, vectors


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Rows ``key, component, n, deviation, whitened, explained, identity_error`` of every usable vector (see ``integers``).

    Components are numbered from 1 by falling variance, ``count`` of them or as many as there are dimensions. A component
    without variance (constant or dependent dimensions, a single vector) has null in ``whitened`` and takes no part in
    identity_error; without any variance explained and identity_error are null. A deviation beyond a long is null. Equal
    variances leave their directions open within their plane; repeated rows get the same figures; null keys stay null; an
    empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    rows, d = integers(df, key, vector)
    n, total = sums(rows, d) if d else (0, [])
    name = f"`{key}`"
    kind = df.schema[key].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"{name} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    count = min(count, d)
    values, vectors = components(triangle(rows, n, total), count)
    spread = values[:count] > (d * _EPS) ** 2 * values[0] if values[0] > 0 else np.zeros(count, bool)
    weights = vectors / np.sqrt(np.where(spread, values[:count] / n, 1.0))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, mean = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            w = (_centred(_matrix(batch, d), n, total).astype(float) / n) @ weights
            square += w.T @ w
            mean += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(count * count + count), pa.int32()), pa.array(np.append(square.ravel(), mean))], ["at", "v"])

    got = rows.select("x").mapInArrow(gram, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r["v"] for r in got]) / n  # a row per pair of components
    mean = flat[count * count :]
    covariance = flat[: count * count].reshape(count, count) - np.outer(mean, mean)
    off = np.abs(covariance - np.eye(count))[np.ix_(spread, spread)]
    error = float(off.max()) if off.size else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            if not len(x):
                continue
            z = _centred(x, n, total)
            far = max(1, *(int(abs(v)) for v in (z.min(), z.max())))
            if z.dtype != object and not _fits(far, far, d):
                z = z.astype(object)
            deviation = [v if v < 1 << 63 else None for v in map(int, (z * z).sum(1))]
            w = (z.astype(float) / n) @ weights
            flat = pa.array(w.ravel(), mask=np.tile(~spread, len(w)))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * count), flat)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(deviation, pa.int64()), listed], ["key", "deviation", "w"])

    share = F.array(*[F.lit(float(v / values.sum()) if values.sum() > 0 else None).cast("double") for v in values[:count]])
    done = rows.mapInArrow(project, f"key {kind}, deviation long, w array<double>")
    return done.select(F.col("key").alias(key), "deviation", F.posexplode("w").alias("at", "whitened")).select(
        name, (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
