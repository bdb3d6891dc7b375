"""Whitening of embeddings by a bidiagonal qd solver.

Only the triangular factor of the centred vectors is needed, and it is found block by block: every task reduces its rows
by QR, the factors are reduced again in a few slots, and the last factor (dimensions x dimensions, for any number of
rows) is solved on the driver:

1. Householder reflections from both sides make the factor bidiagonal. Its squared singular values are n times the
   eigenvalues of the covariance, without the covariance ever being formed.
2. dqds: differential quotient-difference steps with shifts find the singular values to high relative accuracy. Each
   shift is a lower bound of the least one that is left, or a larger guess that is taken back when it fails.
3. A twisted factorisation of every shifted matrix gives the vector of its singular value; where values lie close
   together the vectors are made orthogonal. The reflections turn them into whitening directions.

The whitened rows, and the covariance that proves them, are computed where the vectors lie.

Defined results: rows with a null vector, an empty vector, null, infinite or undefined entries, or entries that no 64-bit
fixed-point number holds, are left out; so are vectors shorter than the longest one that is left. Each distinct vector is
fitted once, however often it comes, and every row that remains is returned, null ids and repeated ids included.
Directions without spread (an eigenvalue of zero up to rounding) are no components: fewer than two distinct vectors give
no row, nor does an empty table. ``deviation`` is null where it leaves the 64-bit range. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import load
from cellweave.session import cut_lineage

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Rows of one local QR step, and slots of the second level.
BLOCK_ROWS = 2_048
SLOTS = 32
_EPS = np.finfo(float).eps

# -- the bidiagonal solver ------------------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, right reflections' product) of a square matrix, by Householder reflections."""
    a, size = r.astype(float).copy(), len(r)
    right = np.eye(size)

    def reflect(x: np.ndarray) -> np.ndarray | None:
        """Unit vector of the reflection that leaves only the first entry."""
        rest = np.linalg.norm(x)
        if rest == 0 or not np.any(x[1:]):
            return None
        v = x.copy()
        v[0] += np.copysign(rest, x[0])
        return v / np.linalg.norm(v)

    for k in range(size):
        if (v := reflect(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < size - 2 and (v := reflect(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float] | None:
    """One differential qd step; also the least intermediate and the sum of their inverses. None if the shift is too large."""
    d, least, inverse = q[0] - shift, float("inf"), 0.0
    new_q, new_e = [], []
    for i in range(len(e)):
        if d < 0:
            return None
        least = min(least, d)
        inverse += 1 / d if d > 0 else float("inf")
        total = d + e[i]
        ratio = q[i + 1] / total if total > 0 else 0.0
        new_q.append(total)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift if total > 0 else q[i + 1] - shift
    if d < 0:
        return None
    inverse += 1 / d if d > 0 else float("inf")
    return [*new_q, d], new_e, min(least, d), inverse


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling, to high relative accuracy."""
    found: list[float] = []
    work = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    while work:
        q, e, done = work.pop()
        guess = 0.0
        while q:
            if len(q) == 1:
                found.append(q[0] + done)
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _EPS**2 * (done + min(q[i], q[i + 1]))), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], done))
                q, e, guess = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if q[0] < q[-1]:  # the steps push small values to the end
                q, e = q[::-1], e[::-1]
            step = _step(q, e, guess)
            if step is None:
                guess = 0.0
                step = _step(q, e, 0.0)
            else:
                done += guess
            q, e, least, inverse = step
            # the inverse of the sum never exceeds the least value; the least intermediate never falls below it
            safe = 1 / inverse * (1 - 1e-12) if inverse > 0 else 0.0
            guess = max(safe, least * (1 - 1 / len(q)) if least < 2 * safe else safe)
    return np.sort(np.array(found))[::-1]


def _twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """Vector of one squared singular value, from the twisted factorisation with the least pivot at its twist."""
    n = len(diagonal)
    if n == 1:
        return np.ones(1)
    tiny = np.finfo(float).tiny ** 0.5
    d = np.maximum(diagonal**2, tiny)
    low = upper / np.where(diagonal[:-1] == 0, tiny**0.5, diagonal[:-1])
    plus, minus, s, p = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, d[-1] - value
    for i in range(n - 1):
        pivot = d[i] + s[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        plus[i] = d[i] * low[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        minus[i] = low[i] * d[i] / pivot
        p[i] = p[i + 1] * d[i] / pivot - value
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z)


def principal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of a square matrix, falling; zero ones left out."""
    size = len(r)
    scale = np.abs(r).max(initial=0.0)
    if scale == 0:
        return np.zeros(0), np.zeros((size, 0))
    diagonal, upper, right = bidiagonal(r / scale)
    norm = max(np.abs(diagonal).max(), np.abs(upper).max(initial=0.0))
    # zero couplings cut the matrix into blocks, each with vectors of its own
    upper[np.abs(upper) <= _EPS * norm] = 0.0
    edges = [0, *(np.flatnonzero(upper == 0) + 1).tolist(), size]
    values, vectors = [], []
    for lo, hi in zip(edges[:-1], edges[1:]):
        d, e = diagonal[lo:hi], upper[lo : hi - 1]
        for value in dqds(d, e):
            z = np.zeros(size)
            z[lo:hi] = _twisted(d, e, value)
            values.append(value)
            vectors.append(z)
    order = np.argsort(values, kind="stable")[::-1]
    values = np.array(values)[order]
    order = order[values > (_EPS * size * norm) ** 2]
    values = values[: len(order)]
    z = np.array(vectors)[order].T
    for i in range(len(order)):
        for k in range(i - 1, -1, -1):
            if values[k] - values[i] > 1e-3 * values[k]:
                break
            z[:, i] -= z[:, k] * (z[:, k] @ z[:, i])
        z[:, i] /= np.linalg.norm(z[:, i])
    return values * scale**2, right @ z


# -- passes over the vectors ----------------------------------------------------------------------------------------


def fixed_point(vector: str | Column) -> Column:
    """Entries as 64-bit integers; null entries where there is no such number."""
    col = F.col(vector) if isinstance(vector, str) else vector
    scaled = F.transform(col, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    ok = F.forall(col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 1e16))
    return F.when(F.coalesce(ok, F.lit(False)) & (F.size(col) > 0), F.transform(scaled, lambda c: c.cast("bigint") + SHIFT))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _fold(df: DataFrame, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray], merge, dim: int) -> np.ndarray:
    """Fold the rows of every task, then the tasks of every slot; ``SLOTS`` arrays at most reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                state = add(state, _matrix(batch.slice(lo, BLOCK_ROWS), dim))
        yield pa.RecordBatch.from_pydict({"m": pa.array([state.ravel().tobytes()], pa.binary())})

    like = start()

    def read(parts) -> np.ndarray:
        state = start()
        for part in parts:
            state = merge(state, np.frombuffer(part, like.dtype).reshape(like.shape))
        return state

    def join(table: pa.Table) -> pa.Table:
        return pa.table({"m": pa.array([read(table["m"].to_pylist()).ravel().tobytes()], pa.binary())})

    slot = F.pmod(F.spark_partition_id(), F.lit(SLOTS)).alias("slot")
    parts = df.mapInArrow(partial, "m binary").select("m", slot).groupBy("slot").applyInArrow(join, "m binary")
    return read(r["m"] for r in parts.collect())


def fit(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """(n, sums, eigenvalues, unit eigenvectors as columns, trace) of distinct integer vectors ``x``."""
    sums = _fold(
        vectors, lambda: np.zeros(dim + 1, np.int64), lambda s, x: s + np.append(x.sum(0), len(x)), lambda a, b: a + b, dim
    )
    n, total = int(sums[-1]), sums[:-1]
    if not n:
        return 0, total, np.zeros(0), np.zeros((dim, 0)), 0.0
    mean = total / n

    def reduce(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((dim, dim))
        factor = np.linalg.qr(np.vstack([r, rows]), mode="r")
        out[: len(factor)] = factor
        return out

    # x is whole and the mean a quotient: both are near, so their difference keeps its digits
    r = _fold(vectors, lambda: np.zeros((dim, dim)), lambda s, x: reduce(s, x - mean), reduce, dim)
    values, directions = principal(r)
    return n, total, values / n, directions, float((r * r).sum() / n)


_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per vector and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), fixed_point(vector).alias("x")).where("x IS NOT NULL")
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], _OUT)
    rows = rows.where(F.size("x") == dim)
    distinct = cut_lineage(rows.select("x").distinct())
    n, total, values, directions, trace = fit(distinct, dim)
    values, directions = values[:components], directions[:, :components]
    k = len(values)
    if not k:
        return spark.createDataFrame([], _OUT)
    mean, turn = total / n, directions / np.sqrt(values)

    def moments(state: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return state + np.vstack([w.T @ w, w.sum(0)])

    seen = _fold(distinct, lambda: np.zeros((k + 1, k)), moments, lambda a, b: a + b, dim) / n
    error = float(np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k)).max())
    explained = values / trace
    far = float(np.iinfo(np.int64).max)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(lo, BLOCK_ROWS)
                x = _matrix(batch, dim)
                rough = ((n * x.astype(float) - total) ** 2).sum(1)
                exact = ((n * x - total) ** 2).sum(1)
                ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(batch.num_rows), k)))
                columns = {
                    "vec_id": ids,
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    "n": pa.array(np.full(len(ids), n, np.int64)),
                    "deviation": pa.array(np.repeat(exact, k), mask=np.repeat(rough >= 0.999 * far, k)),
                    "whitened": pa.array(((x - mean) @ turn).ravel()),
                    "explained": pa.array(np.tile(explained, batch.num_rows)),
                    "identity_error": pa.array(np.full(len(ids), error)),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(project, _OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))
