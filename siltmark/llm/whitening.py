"""Embedding whitening by spectrum slicing (operator 12).

Spark adds up sums and centred products of all vectors as partial results of each task; what reaches the driver is one
matrix of the embedding's dimension.  The inertia of V - s*I, read off the pivots of its LDL' factors, counts the
eigenvalues above s.  Bisection on that count isolates each leading eigenvalue, Rayleigh quotient iteration then
converges to it cubically, and two more counts just below and above the result certify its number.  Spark projects all
vectors on the components and adds up the covariance of what comes out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.sharing import read

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0 ** 51  # 1024 * entry + 100000 and differences of two such stay 64-bit integers
EXACT = 2.0 ** 62
EPS = float(np.finfo(float).eps)
PIVOT = (1 + math.sqrt(17)) / 8


def count_above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of symmetric ``v`` above ``shift``: positive pivots of the LDL' factors of v - shift * I.

    Pivots are the largest left, one by one or as a 2 x 2 block, which has one eigenvalue of either sign.
    """
    a = v - shift * np.eye(len(v))
    above = 0
    while len(a):
        diagonal = np.abs(a.diagonal())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        r, (p, q) = int(diagonal.argmax()), np.unravel_index(int(off.argmax()), off.shape)
        if diagonal[r] == 0 and off[p, q] == 0:
            break
        block = [r] if diagonal[r] >= PIVOT * off[p, q] else [int(p), int(q)]
        above += int(len(block) == 2 or a[r, r] > 0)
        rest = np.setdiff1d(np.arange(len(a)), block, assume_unique=True)
        side = a[np.ix_(rest, block)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(block, block)], side.T)
        a = (a + a.T) / 2
    return above


def rayleigh(v: np.ndarray, low: float, high: float, known: np.ndarray, tolerance: float) -> tuple[float, np.ndarray, float]:
    """Eigenvalue, unit vector and residual from quotient iteration started inside an interval, orthogonal to ``known`` rows."""
    d = len(v)
    value = (low + high) / 2
    x = np.random.default_rng(len(known)).normal(size=d)
    best = (value, x / np.linalg.norm(x), math.inf)
    for step in range(60):
        shifted = v - value * np.eye(d)
        try:
            y = np.linalg.solve(shifted, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(shifted + tolerance * np.eye(d), x)
        y /= np.abs(y).max()
        for _ in range(2):
            y = y - known.T @ (known @ y)
        x = y / np.linalg.norm(y)
        value = float(x @ (v @ x)) if step else value  # one step of inverse iteration first
        residual = float(np.linalg.norm(v @ x - float(x @ (v @ x)) * x))
        if residual < best[2] or step < 2:
            best = (float(x @ (v @ x)), x, residual)
        elif residual >= best[2] / 2:
            break
    return best


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``v``, falling, and their unit vectors as rows.

    Equal eigenvalues, which no count can tell apart, get orthogonal vectors of their space.  Raises ArithmeticError if
    a count contradicts a result.
    """
    d = len(v)
    norm = float(np.abs(v).sum(axis=1).max()) or 1.0
    v = v / norm
    tolerance = 8 * d * EPS
    counts = {-2.0: d, 2.0: 0}

    def count(s):
        if s not in counts:
            counts[s] = count_above(v, s)
        return counts[s]

    values, vectors = [], np.empty((0, d))
    for number in range(1, min(k, d) + 1):
        low, high = max(s for s, c in counts.items() if c >= number), min(s for s, c in counts.items() if c < number)
        while True:
            alone = count(low) == number and count(high) == number - 1
            if alone or high - low <= tolerance:
                value, x, residual = rayleigh(v, low, high, vectors, tolerance)
                if low - tolerance <= value <= high + tolerance and residual <= tolerance or high - low <= tolerance:
                    break
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= number else (low, middle)
        slack = tolerance + 2 * residual
        if count(value - slack) < number or count(value + slack) >= number:
            raise ArithmeticError(f"eigenvalue {number} is not certified")
        values.append(value)
        vectors = np.vstack([vectors, x])
    return np.array(values) * norm, vectors


def usable(embedding: str) -> Column:
    """True for vectors without null, non-finite or (beyond 2**51) unstorable entries."""
    return F.coalesce(F.size(embedding) > 0, F.lit(False)) & F.coalesce(F.forall(embedding, lambda e: F.abs(e.cast("double")) < LARGEST), F.lit(False))


def integers(column: pa.Array, d: int) -> np.ndarray:
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)).astype(np.int64) + SHIFT


def added(rows: DataFrame) -> np.ndarray:
    """Sum over tasks of the arrays ``part``, element by element."""
    t = rows.select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("v")).toArrow()
    return t.column("v").to_numpy()[np.argsort(t.column("pos").to_numpy())]


class Frame:
    """What every task needs of the fit list: its size, the whole and the remaining part of each mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.d = n, len(sums)
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n*x - S)^2; null where they do not fit a long."""
        far = (x - self.floor).astype(float) * self.n - self.rest
        fits = (far * far).sum(axis=1) < EXACT
        step = np.where(fits[:, None], x - self.floor, 0) * self.n - np.where(fits[:, None], self.rest, 0)
        out = (step * step).sum(axis=1).tolist()
        for i in np.flatnonzero(~fits):
            whole = sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(x[i] - self.floor, self.rest, strict=True))
            out[i] = whole if whole < 1 << 63 else None
        return out


def fitted(d: DataFrame, dimension: int) -> tuple[Frame, np.ndarray]:
    """Exact sums and the centred covariance (divisor n) of all vectors."""

    def sums(batches):
        part = np.zeros(2 * dimension + 1, np.int64)
        for b in batches:
            x = integers(b.column(1), dimension)
            part += np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([part.tolist()], pa.list_(pa.int64()))], ["part"])

    whole = added(d.mapInArrow(sums, "part array<long>")).tolist()
    frame = Frame(whole[-1], [(h << 32) + low for h, low in zip(whole[:dimension], whole[dimension:-1], strict=True)])
    upper = np.triu_indices(dimension)

    def products(batches):
        part = np.zeros((dimension, dimension))
        for b in batches:
            y = frame.centred(integers(b.column(1), dimension))
            part += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([part[upper].tolist()], pa.list_(pa.float64()))], ["part"])

    v = np.zeros((dimension, dimension))
    v[upper] = added(d.mapInArrow(products, "part array<double>")) / frame.n
    return frame, v + np.triu(v, 1).T


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per remaining vector and component.

    Vectors that are null, empty or hold a null, a non-finite entry or one of 2**51 and more are left out; of vectors
    of several lengths the commonest length counts (the longest among equals), since others belong to no such space.
    Directions without variance cannot be whitened and have no rows.  Repeated rows count as often as they occur; null
    ids stay; other columns are not read; no vectors in, no rows out.  ``deviation`` is null if it does not fit a long.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double"
    d = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("e")).filter(usable("e"))
    lengths = d.groupBy(F.size("e").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], shape + ", identity_error double")
    dimension = lengths.k
    d = d.filter(F.size("e") == dimension)
    frame, v = fitted(d, dimension)
    values, axes = leading(v, components)
    some = values > 8 * dimension * EPS * (np.abs(v).sum(axis=1).max() or 1.0)
    values, axes = values[some], axes[some]
    k = len(values)
    onto = (axes / np.sqrt(values)[:, None]).T
    share = values / np.trace(v) if k else values
    upper = np.triu_indices(k)

    def moments(batches):
        part = np.zeros(k + len(upper[0]))
        for b in batches:
            w = frame.centred(integers(b.column(1), dimension)) @ onto
            part += np.concatenate([w.sum(axis=0), (w.T @ w)[upper]])
        yield pa.RecordBatch.from_arrays([pa.array([part.tolist()], pa.list_(pa.float64()))], ["part"])

    error = 0.0
    if k:
        m = added(d.mapInArrow(moments, "part array<double>")) / frame.n
        error = float(np.abs(m[k:] - (m[:k, None] * m[:k])[upper] - np.eye(k)[upper]).max())

    def project(batches):
        for b in batches:
            x = integers(b.column(1), dimension)
            w = frame.centred(x) @ onto
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(rows), frame.n), pa.int64()),
                 pa.array(frame.deviations(x), pa.int64()).take(pa.array(rows)), pa.array(w.ravel()), pa.array(np.tile(share, len(x)))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return d.mapInArrow(project, shape).withColumn("identity_error", F.lit(error))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading whitened components of all embeddings."""
    return whiten(read(spark, sf_dir, "embeddings"))
