"""Whitening of vectors by a bidiagonal qd solver.

Entries become whole numbers, each distinct vector counts once, and the sums over these give exact means. The centred
rows are reduced to one triangle R by QR, block by block inside the tasks and then eight triangles at a time, so no
covariance is ever formed and no task holds more than a block and eight triangles. Householder reflections bring R into
bidiagonal form, dqds gives its singular values to high relative accuracy, twisted factorisations give the directions,
and a last pass projects every row. Only triangles, sums and the covariance of the result, all of a size that depends on
the number of dimensions alone, reach the driver.

Defined results: rows whose vector is null or holds null or non-finite entries go; entries beyond 2^53 units, which a
double no longer counts one by one, are held there; a deviation of more than 38 digits is null; vectors of each length are whitened among themselves, and those without entries go. Directions without spread
(a standard deviation below 10^-11 of the largest) have no component, so one distinct vector alone gives empty lists.
Equal rows give equal values, null ids pass through, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import saved

UNITS, OFFSET = 64, 1_000_000
HELD = 2**53
DIGITS = 10**38
COMPONENTS = 16
FLAT = 1e-11  # least standard deviation of a component, against the largest
FAN = 8
EPS = float(np.finfo(float).eps)
TOLERANCE = (10 * EPS) ** 2


# --- the bidiagonal solver ----------------------------------------------------------------------------
def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, t, a) with (1 - t v v') x = (a, 0, ..., 0)."""
    size = float(np.linalg.norm(x))
    if size == 0.0 or not np.any(x[1:]):
        return np.zeros_like(x), 0.0, float(x[0])
    a = -math.copysign(size, x[0])
    v = x.copy()
    v[0] -= a
    return v, 2.0 / float(v @ v), a


def bidiagonal(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, V): triangle = U B V' for an orthogonal U that is not kept."""
    size = triangle.shape[1]
    # a triangle of few rows ends in zeros
    a = np.vstack([triangle, np.zeros((size - min(size, len(triangle)), size))])
    right = np.eye(size)
    diagonal, upper = np.zeros(size), np.zeros(max(0, size - 1))
    for k in range(size):
        v, t, diagonal[k] = _reflector(a[k:, k])
        if t:
            a[k:, k + 1 :] -= np.outer(t * v, v @ a[k:, k + 1 :])
        if k + 1 < size:
            v, t, upper[k] = _reflector(a[k, k + 1 :])
            if t:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k + 1 :] @ v, t * v)
                right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ v, t * v)
    return diagonal, upper, right


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int, float]:
    """One dqds transform: (q, e, first place where it fails or -1, value there)."""
    last = len(q) - 1
    q_new, e_new = [0.0] * (last + 1), [0.0] * last
    d = q[0] - shift
    for k in range(last):
        if not d >= 0.0:
            return q_new, e_new, k, d
        q_new[k] = total = d + e[k]
        if total == 0.0:
            return q_new, e_new, k, -1.0
        ratio = q[k + 1] / total
        e_new[k] = e[k] * ratio
        d = d * ratio - shift
    q_new[last] = d
    return q_new, e_new, (-1 if d >= 0.0 else last), d


def _least_of_last_two(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows: close to the smallest of all when these are nearly apart."""
    a, b = q[-2] + e[-1], q[-1]
    cross = q[-1] * e[-1]
    half = (a + b) / 2
    return max(0.0, (a * b - cross) / (half + math.sqrt(max(0.0, ((a - b) / 2) ** 2 + cross))) if half else 0.0)


def singular_values(diagonal: np.ndarray, upper: np.ndarray) -> list[float]:
    """Singular values of an upper bidiagonal matrix by dqds, largest first."""
    scale = max([abs(x) for x in [*diagonal, *upper]], default=0.0)
    if scale == 0.0:
        return [0.0] * len(diagonal)
    # a zero on the diagonal is moved by less than a rounding of the largest entry
    least = EPS / 16
    q = [max(abs(float(x)) / scale, least) ** 2 for x in diagonal]
    e = [(float(x) / scale) ** 2 for x in upper]
    open_parts, found = [(q, e, 0.0)], []
    while open_parts:
        q, e, sigma = open_parts.pop()
        rounds = 0
        while len(q) > 1:
            if e[-1] <= TOLERANCE * (sigma + q[-1]):
                found.append(sigma + q.pop())
                e.pop()
                continue
            cut = next((k for k, x in enumerate(e) if x <= TOLERANCE * (sigma + min(q[k], q[k + 1]))), None)
            if cut is not None:
                open_parts.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q.reverse()
                e.reverse()
            shift = _least_of_last_two(q, e)
            while True:
                q_new, e_new, failed, value = _step(q, e, shift)
                if failed < 0:
                    break
                if shift == 0.0:
                    raise ArithmeticError("dqds failed without a shift")
                # a failure at the very end says by how much the shift was too large
                late = shift + value if failed == len(q) - 1 else 0.0
                shift = late * (1 - 2 * EPS) if 0.0 < late < shift else shift / 4 if shift > TOLERANCE * (sigma + q[-1]) else 0.0
            q, e, sigma = q_new, e_new, sigma + shift
            rounds += 1
            if rounds > 60 * len(diagonal) + 600:
                raise ArithmeticError("dqds does not converge")
        found.extend(sigma + x for x in q)
    return sorted((math.sqrt(x) * scale for x in found), reverse=True)


def _twisted(d: np.ndarray, e: np.ndarray, value: float) -> np.ndarray:
    """The direction z of B'B z = value z: stationary and progressive factors meet where the residual is least."""
    size = len(d)
    big = d * d
    low = e / d[:-1]
    tiny = EPS * EPS * float(np.max(big) + (np.max(e * e) if size > 1 else 0.0))
    down, up = np.zeros(size), np.zeros(size)
    s, p = np.zeros(size), np.zeros(size)
    s[0] = -value
    for k in range(size - 1):
        pivot = s[k] + big[k]
        if abs(pivot) < tiny:
            pivot = -tiny
        down[k] = big[k] * low[k] / pivot
        s[k + 1] = down[k] * low[k] * s[k] - value
    p[size - 1] = big[size - 1] - value
    for k in range(size - 2, -1, -1):
        pivot = big[k] * low[k] * low[k] + p[k + 1]
        if abs(pivot) < tiny:
            pivot = -tiny
        ratio = big[k] / pivot
        up[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(size)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(twist, size - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            z = z - (other @ z) * other
    return z


def _direction(d: np.ndarray, e: np.ndarray, value: float, close: list[np.ndarray]) -> np.ndarray:
    """The direction of `value`, at right angles to those of values `close` to it."""
    z = _apart(_twisted(d, e, value), close)
    if np.linalg.norm(z) < 0.5:
        # values equal up to rounding: inverse iteration among what the others leave
        whole = np.diag(d * d) + np.diag(d[:-1] * e, 1) + np.diag(d[:-1] * e, -1)
        whole[np.arange(1, len(d)), np.arange(1, len(d))] += e * e
        z = _apart(np.random.default_rng(len(close)).standard_normal(len(d)), close)
        shifted = whole - value * (1 + 4 * EPS) * np.eye(len(d))
        for _ in range(4):
            z = _apart(np.linalg.lstsq(shifted, z / np.linalg.norm(z), rcond=None)[0], close)
            z /= np.linalg.norm(z)
    return z / np.linalg.norm(z)


def directions(triangle: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of a triangle, the `most` largest that are not flat."""
    diagonal, upper, right = bidiagonal(triangle)
    size = len(diagonal)
    scale = max(np.max(np.abs(diagonal), initial=0.0), np.max(np.abs(upper), initial=0.0))
    if scale == 0.0:
        return np.zeros(0), np.zeros((size, 0))
    least = scale * EPS / 16
    diagonal = np.where(np.abs(diagonal) < least, least, diagonal)
    cuts = [0, *(k + 1 for k in range(size - 1) if abs(upper[k]) <= EPS * (abs(diagonal[k]) + abs(diagonal[k + 1])) / 4), size]
    parts = []
    for start, end in zip(cuts, cuts[1:], strict=False):
        d, e = diagonal[start:end] / scale, upper[start : end - 1] / scale
        parts += [(value * scale, start, end, d, e) for value in singular_values(d, e)]
    parts.sort(key=lambda x: -x[0])
    kept = [x for x in parts[:most] if x[0] > FLAT * parts[0][0]]
    columns: list[np.ndarray] = []
    for k, (value, start, end, d, e) in enumerate(kept):
        # neighbours in the same part whose values run into this one
        close, nearest = [], value
        for before in range(k - 1, -1, -1):
            if kept[before][1] == start:
                if kept[before][0] - nearest > 1e-3 * kept[before][0]:
                    break
                nearest = kept[before][0]
                close.append(columns[before][start:end])
        z = np.zeros(size)
        z[start:end] = _direction(d, e, (value / scale) ** 2, close)
        columns.append(z)
    vectors = right @ np.array(columns).T
    # either sign is right: the largest entry is positive
    vectors *= np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(kept))])
    return np.array([x[0] for x in kept]), vectors


# --- the passes over the vectors -------------------------------------------------------------------------
class Fit:
    """Exact sums over the distinct vectors of one length, and what whitens them."""

    def __init__(self, count: int, sums: list[int]):
        self.count, self.sums = count, sums
        whole = [s // count for s in sums]
        self.whole = np.array(whole, np.int64)
        self.rest = [s - w * count for s, w in zip(sums, whole, strict=True)]
        self.fraction = np.array([r / count for r in self.rest])
        self.project = np.zeros((len(sums), 0))
        self.explained: list[float] = []
        self.identity_error = 0.0

    def solve(self, triangle: np.ndarray, most: int) -> None:
        values, vectors = directions(triangle, most)
        self.project = vectors / (values / math.sqrt(self.count))
        total = float(np.sum(triangle * triangle))
        self.explained = [float(v * v) / total for v in values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - mean, rounded twice at most: the whole part of the mean goes first, exactly."""
        return (x - self.whole).astype(float) - self.fraction

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """Sum over dimensions of (count * x - sum)^2, exact."""
        y = x - self.whole
        reach = int(np.max(np.abs(y), initial=0))
        small = len(self.sums) * reach * max(reach, self.count) < 2**62
        y = y if small else y.astype(object)
        rest = np.array(self.rest, np.int64 if small else object)
        squares, crossed = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist()
        constant = sum(r * r for r in self.rest)
        n = self.count
        totals = [n * n * s - 2 * n * c + constant for s, c in zip(squares, crossed, strict=True)]
        return [Decimal(t) if t < DIGITS else None for t in totals]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def units(vector: Column) -> Column:
    """Entries in whole units."""
    held = lambda e: F.least(F.greatest(e * F.lit(float(UNITS)), F.lit(-float(HELD))), F.lit(float(HELD)))
    return F.transform(vector.cast("array<double>"), lambda e: F.floor(held(e)) + F.lit(OFFSET))


def usable(vector: Column) -> Column:
    good = F.forall(vector.cast("array<double>"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, [0] * size
        for batch in batches:
            x = matrix(batch.column("x"), size)
            if int(np.max(np.abs(x), initial=0)) * max(1, len(x)) >= 2**62:
                x = x.astype(object)
            rows += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0), strict=True)]
        if rows:
            totals = pa.array([Decimal(s) for s in [rows, *sums]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), totals], ["place", "total"])

    parts = fit.mapInArrow(add, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    count, *sums = [int(r.total) for r in sorted(parts.collect())]
    return count, sums


def _triangle(fit: DataFrame, size: int, model: Fit) -> np.ndarray:
    """R of the centred rows: one triangle per task, then FAN at a time."""
    rows = max(1024, 4 * size)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = np.zeros((0, size))
        for batch in batches:
            x = model.centred(matrix(batch.column("x"), size))
            for at in range(0, len(x), rows):
                triangle = np.linalg.qr(np.vstack([triangle, x[at : at + rows]]), mode="r")
        if len(triangle):
            yield pa.RecordBatch.from_arrays([pa.array([len(triangle)], pa.int32()), pa.array([triangle.tobytes()], pa.binary())], ["height", "r"])

    def stacked(group: pd.DataFrame) -> np.ndarray:
        return np.linalg.qr(np.vstack([np.frombuffer(r).reshape(-1, size) for r in group["r"]]), mode="r")

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        triangle = stacked(group.sort_values("slot"))
        return pd.DataFrame({"slot": [key[0]], "r": [triangle.tobytes()]})

    parts = fit.mapInArrow(reduce, "height int, r binary").select(F.spark_partition_id().cast("bigint").alias("slot"), "r")
    parts = saved(parts, "triangles")
    width = parts.agg(F.max("slot")).first()[0] + 1
    while width > FAN:
        parts = parts.groupBy(F.floor(F.col("slot") / FAN).alias("slot_")).applyInPandas(merge, "slot bigint, r binary")
        width = -(-width // FAN)
    return stacked(pd.DataFrame(parts.orderBy("slot").collect(), columns=["slot", "r"]))


def _identity_error(fit: DataFrame, size: int, model: Fit) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over the distinct vectors."""
    width = model.project.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, sums = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            w = model.centred(matrix(batch.column("x"), size)) @ model.project
            product += w.T @ w
            sums += w.sum(axis=0)
        values = np.concatenate([sums, product.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["place", "total"])

    parts = fit.mapInArrow(multiply, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    totals = np.array([r.total for r in sorted(parts.collect())]) / model.count
    # the rows were centred before; what rounding leaves of their mean goes as well
    mean, product = totals[:width], totals[width:].reshape(width, width)
    return float(np.max(np.abs(product - np.outer(mean, mean) - np.eye(width)), initial=0.0))


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding) that is left: vec_id, n, deviation (decimal), whitened and explained
    (lists, largest component first), identity_error."""
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.where(usable(F.col("embedding"))).select("vec_id", units(F.col("embedding")).alias("x"))
    # equal vectors meet inside the tasks before the shuffle, so a common one is few rows
    fit = saved(rows.select("x").distinct(), "vectors")
    models: dict[int, Fit] = {}
    for size in sorted(r[0] for r in fit.select(F.size("x")).distinct().collect()):
        sized = fit.where(F.size("x") == size)
        model = models[size] = Fit(*_sums(sized, size))
        model.solve(_triangle(sized, size, model), most)
        if model.explained:
            model.identity_error = _identity_error(sized, size, model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                model, x = models[size], matrix(part.column("x"), size)
                white = model.centred(x) @ model.project
                ends = pa.array(range(0, white.size + 1, white.shape[1]) if white.shape[1] else [0] * (len(x) + 1), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([size] * len(x), pa.int32()), pa.array(model.deviations(x), pa.decimal128(38, 0)),
                     pa.ListArray.from_arrays(ends, pa.array(white.ravel()))],
                    ["vec_id", "size", "deviation", "whitened"],
                )

    facts = [(size, m.count, m.explained, m.identity_error) for size, m in models.items()]
    about = spark.createDataFrame(facts, "size int, n bigint, explained array<double>, identity_error double")
    white = rows.mapInArrow(project, f"vec_id {id_type}, size int, deviation decimal(38,0), whitened array<double>")
    # one row per length of vectors
    return white.join(F.broadcast(about), "size").select("vec_id", "n", "deviation", "whitened", "explained", "identity_error")
