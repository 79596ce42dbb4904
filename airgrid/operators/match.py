"""Descriptor matching, slope consensus and least-squares fits."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


#: Rows of b that divide space into cells, at most.
PIVOTS = 1024


def nearest_rows(x: np.ndarray, y: np.ndarray, k: int, digits: int | None = None, slack: float = 0.0, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance) of the k rows of y nearest to each of x; of equals the first in y.  With ``slack`` also
    all whose squared distance is at most the k-th's times 1 + ``slack``.  Squared distances above a row's ``bound`` (NaN: none) aren't
    wanted.

    Products of matrices tell which pairs can be near, with what they may be wrong by; only these are measured."""
    if not k or not len(x) or not len(y):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    k, at, who, far = min(k, len(y)), [], [], []
    middle = y.mean(0)
    a, b = x - middle, y - middle
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    wrong = 16 * (x.shape[1] + 2) * np.finfo(float).eps * (aa + bb.max()) + (0 if digits is None else 10.0**-digits)
    sure = np.isfinite(wrong).all()
    many = max(1, (1 << 21) // len(y)) if sure else 16
    for lo in range(0, len(x), many):
        part = slice(lo, lo + many)
        if sure:
            d = aa[part, None] + bb - 2 * (a[part] @ b.T)
            most = np.full(len(d), np.nan) if bound is None else bound[part]
            open_ = np.isnan(most)
            if open_.any():
                most = most.copy()
                most[open_] = np.maximum(np.partition(d[open_], k - 1, axis=1)[:, k - 1], 0) + wrong[part][open_]
            r, c = np.nonzero(d <= ((most + wrong[part]) * (1 + slack) + wrong[part])[:, None])
            near = ((x[lo + r] - y[c]) ** 2).sum(1)
            near = near if digits is None else np.round(near, digits)
        else:
            d = ((x[part, None] - y) ** 2).sum(2)
            d = d if digits is None else np.round(d, digits)
            r, c = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] * (1 + slack))
            near = d[r, c]
        order = np.lexsort((c, near, r))
        r, c, near = r[order], c[order], near[order]
        first = np.searchsorted(r, np.arange(len(d)))
        won = np.arange(len(r)) - first[r] < k
        if slack:
            kth = near[np.minimum(first + k, np.append(first[1:], len(r))) - 1] if len(r) else np.zeros(len(d))
            won |= near <= kth[r] * (1 + slack)
        at.append(lo + r[won])
        who.append(c[won])
        far.append(near[won])
    return tuple(np.concatenate(z) for z in (at, who, far))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def _fields(df: DataFrame, *without: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def _celled(b: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``b`` with the cell of its nearest pivot, and how far that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(matrix(batch.column("y")), pivots) if batch.num_rows else np.zeros((0, 1))
            cell = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "far"])

    return b.mapInArrow(run, _fields(b) + ", cell int, far double")


def _reaching(a: DataFrame, pivots: np.ndarray, number: np.ndarray, radius: np.ndarray, k: int, digits: int | None, slack: float) -> DataFrame:
    """``a`` with the cells to go to.  Without a column kth that is the cell of the nearest pivot; with it (the squared k-th distance
    found there, or null) all others that can hold one of the k nearest: cells are as far as their pivots, more or less their
    radius, and the nearest of them that surely hold k rows bound the k-th distance too."""
    rough = 0.0 if digits is None else 2 * 10.0**-digits
    again = "kth" in a.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 2048) for whole in batches for lo in range(0, whole.num_rows, 2048)):
            rows = np.arange(batch.num_rows)
            d = _distances(matrix(batch.column("x")), pivots) if len(rows) else np.zeros((0, len(pivots)))
            own = np.where(number > 0, d, np.inf).argmin(1)
            if again:
                order = np.argsort(d + radius, axis=1)
                last = (np.cumsum(number[order], axis=1) >= k).argmax(1)
                most = (d + radius)[rows, order[rows, last]] if number.sum() >= k else np.full(len(rows), np.inf)
                kth = batch.column("kth").to_numpy(zero_copy_only=False)
                most = np.fmin(most, np.sqrt(kth))
                need = (d - radius <= (np.sqrt(most**2 * (1 + slack) + rough) * (1 + 1e-9))[:, None]) & (number > 0)
                need[rows, own] = False
            else:
                need = np.zeros(d.shape, bool)
                need[rows, own] = True
            cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(need.sum(1))].astype(np.int32)), pa.array(np.nonzero(need)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    return a.mapInArrow(run, _fields(a) + ", cells array<int>")


def candidates(a: DataFrame, b: DataFrame, k: int, key: str, tie: str, block: int = 4096, digits: int | None = None, slack: float = 0.0) -> DataFrame:
    """Pairs among which are, for each row of ``a`` (x and other columns, ``key`` among them), the k rows of ``b`` (y and other
    columns) at the least Euclidean distance, ties by ``tie``: the other columns of both and d2, the squared distance (rounded
    to ``digits``).

    Some rows of ``b`` are pivots and divide it into cells.  A row of ``a`` meets the cell of its nearest pivot, then those cells that
    can hold something as near as the k-th found there; only where distances tell nothing (many dimensions) these are all.
    A task holds one block of about ``block`` rows of each side.  Vectors must be of one length and without nulls."""
    total = b.count()
    n = min(PIVOTS, -(-total // block))
    if n <= 1:
        return _met(a.withColumn("cells", F.array(F.lit(0))), b.withColumn("cell", F.lit(0)), np.array([total]), k, key, tie, block, digits, slack)
    some = matrix(pa.chunked_array([pa.array([r.y for r in b.select("y", tie).orderBy(F.xxhash64(tie), tie).limit(2 * n).collect()])]))
    pivots = some[np.sort(np.unique(some, axis=0, return_index=True)[1])[:n]]
    right = cut(_celled(b, pivots))
    number, radius = np.zeros(len(pivots), int), np.zeros(len(pivots))
    for s in right.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect():
        number[s.cell], radius[s.cell] = s.n, s.r
    right = right.drop("far")
    first = cut(_met(cut(_reaching(a, pivots, number, radius, k, digits, slack)), right, number, k, key, tie, block, digits, slack))
    kth = first.groupBy(key).agg(F.get(F.array_sort(F.collect_list("d2")), k - 1).alias("kth"))
    more = cut(_reaching(a.join(kth, key, "left"), pivots, number, radius, k, digits, slack).filter(F.size("cells") > 0))
    return first.unionByName(_met(more, right, number, k, key, tie, block, digits, slack))


def _met(left: DataFrame, right: DataFrame, number: np.ndarray, k: int, key: str, tie: str, block: int, digits: int | None, slack: float) -> DataFrame:
    """The k nearest in each block that rows with ``cells`` meet; ``number``: rows of each cell."""
    mine, theirs = [c for c in left.columns if c not in ("x", "cells", "kth")], [c for c in right.columns if c not in ("y", "cell")]
    fields = f"{_fields(left, 'x', 'cells', 'kth')}, {_fields(right, 'y', 'cell')}, d2 double"
    left = left.withColumn("cell", F.explode("cells")).drop("cells")
    rows = {r.cell: r["count"] for r in left.groupBy("cell").count().collect()}

    def blocks(sizes: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(v) for c in range(len(number)) for v in (c, max(1, -(-sizes.get(c, 0) // block)))]), F.col("cell"))

    of_a, of_b = blocks(rows), blocks(dict(enumerate(number.tolist())))

    def dealt(by: str, count: Column) -> Column:
        return F.pmod(F.xxhash64(by), count).cast("int")

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    groups = ["cell", "part", "sub"]
    left = left.withColumn("part", dealt(key, of_a)).withColumn("sub", every(of_b))
    right = right.withColumn("sub", dealt(tie, of_b)).withColumn("part", every(of_a))

    def near(p: pa.Table, q: pa.Table) -> pa.Table:
        q = q.sort_by(tie)
        at, who, d2 = nearest_rows(matrix(p["x"]), matrix(q["y"]), k, digits, slack, p["kth"].to_numpy().astype(float) if "kth" in p.column_names else None) if len(p) and len(q) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        found = {c: t[c].take(pa.array(i)) for t, names, i in ((p, mine, at), (q, theirs, who)) for c in names}
        return pa.table(found | {"d2": d2})

    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(near, fields)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as the rows of a matrix."""
    if not len(column):
        return np.zeros((0, 1))
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def known(x: str) -> Column:
    """Whether a vector is there in full."""
    return F.coalesce(F.forall(x, lambda v: v.isNotNull()), F.lit(False))


def ratio_match(a: DataFrame, b: DataFrame, ratio: float = 0.75, block: int | None = None) -> DataFrame:
    """(i, j, d): for vectors (id, x) of ``a`` the nearest of ``b`` where it beats ``ratio`` times the second nearest.  Vectors with
    nulls match nothing.  For how blocks meet see ``candidates``; as all of them do where vectors are long, ``block`` grows with the
    tables up to 65,536 rows, so that rows travel seldom."""
    left, right = a.filter(known("x")).select(F.col("id").alias("i"), "x"), b.filter(known("x")).select(F.col("id").alias("j"), F.col("x").alias("y"))
    block = block or min(1 << 16, max(4096, math.isqrt(left.count() * right.count() // 64)))
    met = candidates(left, right, 2, "i", "j", block)
    best = met.groupBy("i").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.sqrt("d2").alias("d"), "j"))), 1, 2).alias("n"))
    return best.filter((F.size("n") == 2) & (F.expr("n[0].d") < ratio * F.expr("n[1].d"))).select("i", F.expr("n[0].j").alias("j"), F.expr("n[0].d").alias("d"))


def consensus_filter(pairs: DataFrame) -> DataFrame:
    """Members of the commonest unit bin of ``slope`` within -360..360 (the lowest of equals); null slopes are left out."""
    p = pairs.filter("slope >= -360 and slope < 360").withColumn("bin", F.floor("slope").cast("int"))
    top = p.groupBy("bin").count().orderBy(F.desc("count"), "bin").limit(1).select("bin")
    return p.join(F.broadcast(top), "bin")


def fit_affine(points: DataFrame, target: str) -> DataFrame:
    """Least squares of target = a c + b r + o for each scene, from sums (Cramer's rule on centred moments)."""
    g = points.groupBy("scene").agg(F.var_pop("c").alias("cc"), F.var_pop("r").alias("rr"), F.covar_pop("c", "r").alias("cr"), F.covar_pop("c", target).alias("cx"), F.covar_pop("r", target).alias("rx"), F.avg("c").alias("mc"), F.avg("r").alias("mr"), F.avg(target).alias("mx"))
    det = F.expr("cc * rr - cr * cr")
    g = g.withColumns({"a": F.try_divide(F.expr("cx * rr - rx * cr"), det), "b": F.try_divide(F.expr("rx * cc - cx * cr"), det)})
    return g.select("scene", "a", "b", F.expr("mx - a * mc - b * mr").alias("o"))
