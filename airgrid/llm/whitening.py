"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows X.

Every step multiplies the rows once by a new direction (X v) and the result back (X^T u).  A left vector u_j has an entry for each
row of the table; it is never stored.  As u_j = X w_j, tasks make their rows' entries of all left vectors anew from
the few w_j, measure how far the new one is from being orthogonal to them, and send sums of a few numbers.  What is known of
X^T u_j takes out most of it beforehand, the measured rest is taken out afterwards: so left and right vectors are fully
reorthogonalised with one pass a step.  The singular values and vectors of the small bidiagonal matrix, on the driver, give deviations and
components.

Entries are whole numbers, so sums, means and deviations are exact; rows are centred before anything is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stage

#: c becomes floor(SCALE * c) + SHIFT; entries of LARGEST or more aren't whole numbers that a double holds.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 52)
#: Below this share of the largest singular value a direction counts as none.
NOTHING = 1e-13


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x (array of long).  Vectors that are null, empty or hold entries that are null, not finite or too
    large to be scaled are dropped, and so are vectors of another length than most (of equally frequent ones, the longest)."""
    held = rows.select(rows[vec_id].alias("vec_id"), rows[vector].alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST / SCALE))
    held = held.filter(F.coalesce(fine, F.lit(False)) & (F.size("v") > 0))
    most = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    v = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return stage(held.filter(F.size("v") == (most.d if most else 0)).select("vec_id", v.alias("x")))


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # one in each row, of unit length
    variances: np.ndarray
    trace: float


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _summed(table: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``sums`` of the rows of every task, added up: a row for each entry and task is shuffled, and one for each entry collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "value"])

    got = table.select("x").mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r.k] = r.value
    return out


def _centred(n: int, sums: list[int], exact: bool) -> Callable[[np.ndarray], np.ndarray]:
    """Rows minus the mean.  n * x - S is a whole number; it is rounded once, or where it may not fit 64 bits, the mean is."""
    s = np.array(sums, object)
    if exact:
        whole = s.astype(np.int64)
        return lambda x: (n * x - whole) / n
    mean = np.array([float(v) / n for v in sums])
    return lambda x: x - mean


def _statistics(table: DataFrame) -> tuple[int, list[int], list[int]]:
    """Number of vectors, exact sums, and for each dimension the largest |n x - S|."""
    each = table.select(F.posexplode("x").alias("k", "c"))
    got = sorted(each.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.min("c").alias("lo"), F.max("c").alias("hi")).collect())
    n = got[0].n if got else 0
    return n, [int(r.s) for r in got], [max(abs(n * r.lo - int(r.s)), abs(n * r.hi - int(r.s))) for r in got]


def fit(table: DataFrame, components: int = 8, steps: int | None = None, seed: int = 11) -> tuple[Whitening, list[int]]:
    """Whitening of the vectors of ``whole_vectors`` and, for each dimension, the largest |n x - S|.

    ``steps``: at most so many; without it, as many as there are dimensions, which finds components of equal variance too.  Where a
    direction leads nowhere (a singular value of 0, or all of an invariant space is found), the next starts anew, orthogonal to
    those before.  There are fewer than ``components`` where fewer directions vary.  The driver holds some vectors of
    the dimensions for each step, tasks a batch of rows."""
    n, sums, far = _statistics(table)
    d = len(sums)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0), far
    centre = _centred(n, sums, max(far) < 1 << 62)
    rng = np.random.default_rng(seed)
    trace = float(_summed(table, lambda x: np.array([(centre(x) ** 2).sum()]))[0])
    scale, rounds = sqrt(trace), min(steps or d, d)
    right, back, ways = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))  # v_j, X^T u_j and w_j
    b = np.zeros((rounds, rounds))

    def start() -> np.ndarray:
        v = rng.standard_normal(d)
        for _ in range(3):
            v -= right.T @ (right @ v)
            v /= np.linalg.norm(v)
        return v

    v = start()
    for j in range(rounds):
        right = np.vstack([right, v])
        w = v - ways.T @ (back @ v)

        def products(x: np.ndarray, w: np.ndarray = w, ways: np.ndarray = ways) -> np.ndarray:
            x = centre(x)
            u = x @ w
            return np.concatenate([[u @ u], (x @ ways.T).T @ u, x.T @ u])

        got = _summed(table, products)
        square, off, z = got[0], got[1 : 1 + j], got[1 + j :]
        w, z = w - ways.T @ off, z - back.T @ off
        alpha = sqrt(max(0.0, square - off @ off))
        if alpha <= NOTHING * scale:
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, z = w / alpha, z / alpha
        b[j, j] = alpha
        ways, back = np.vstack([ways, w]), np.vstack([back, z])
        if j + 1 == rounds:
            break
        r = z - alpha * v
        for _ in range(2):
            r -= right.T @ (right @ r)
        beta = float(np.linalg.norm(r))
        if beta <= NOTHING * scale:
            v = start()
        else:
            v, b[j, j + 1] = r / beta, beta
    _, deviation, turn = np.linalg.svd(b)
    found = turn[:components] @ right
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    found *= np.sign(found[np.arange(len(found)), np.abs(found).argmax(1)])[:, None]
    some = deviation[:components] > 1e-10 * max(scale, 1e-300)
    return Whitening(n, sums, found[some], (deviation[:components] ** 2 / n)[some], trace / n), far


def whiten(rows: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding", steps: int | None = None) -> DataFrame:
    """Each remaining vector on each component: vec_id, component (from 1), n, deviation (sum over dimensions of (n x - S)^2, exact; null if
    over 64 bits), whitened, explained (share of the variance) and identity_error (the largest entry of the whitened vectors' covariance minus the identity).

    For which vectors are dropped see ``whole_vectors``; null or repeated ids are kept.  Components of no variance aren't
    returned: equal vectors alone, one vector or an empty table give an empty result.  Other columns are not read."""
    table = whole_vectors(rows, vec_id, vector)
    kind = rows.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted, far = fit(table, components, steps)
    k = len(fitted.components)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, small = fitted.n, fitted.sums, sum(v * v for v in far) < 1 << 63
    centre = _centred(n, sums, max(far) < 1 << 62)
    project = fitted.components.T / np.sqrt(fitted.variances)

    def covariance(x: np.ndarray) -> np.ndarray:
        z = centre(x) @ project  # of mean 0, as the rows are centred
        return (z.T @ z).ravel()

    error = float(np.abs(_summed(table, covariance).reshape(k, k) / n - np.eye(k)).max())
    explained = fitted.variances / fitted.trace

    def deviations(x: np.ndarray) -> pa.Array:
        if small:
            return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(1))
        exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch), batch.num_rows
            at = pa.array(np.repeat(np.arange(m), k))
            z = centre(x) @ project
            columns = [batch.column("vec_id").take(at), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), deviations(x).take(at), z.ravel(), np.tile(explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.mapInArrow(run, schema)
