"""Resampling, gap filling, connected areas, perimeters, contextual relabelling and superpixels of pixel tables."""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .tiles import whole_groups

PIXEL = ["scene", "r", "c"]


def _near(half: int) -> Column:
    return F.sequence(F.lit(-half), F.lit(half))


#: Cells of a scene's extent up to which it is worked on in one batch, among others.
SMALL = 1 << 14


def _by_size(pixels: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """Cells of scenes whose extent (and number of rows) is at most ``small`` cells, and the others' if there are any."""
    area = (F.max("r") - F.min("r") + 1).cast("double") * (F.max("c") - F.min("c") + 1)
    size = pixels.groupBy("scene").agg(area.alias("area"), F.count("*").alias("n"))
    large = cut(size.filter((F.col("area") > small) | (F.col("n") > small) | F.col("scene").isNull()).select(F.col("scene").alias("large")))
    if large.isEmpty():
        return pixels, None
    same = F.col("scene").eqNullSafe(F.col("large"))
    return pixels.join(F.broadcast(large), same, "left_anti"), pixels.join(F.broadcast(large), same, "left_semi")


def _kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def _group_of(t: pa.Table, starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))


# resampling
#: Source cells on either side of a position that have weight.
REACH = {"nearest": 0.5, "bilinear": 1.0, "cubic": 2.0}


def _taps(x: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Source cells and weights (tap by position) for positions counted from the middle of cell 0."""
    if method == "nearest":
        return np.floor(x + 0.5).astype(int)[None], np.ones((1, len(x)))
    at = np.floor(x).astype(int) + np.array([0, 1] if method == "bilinear" else [-1, 0, 1, 2])[:, None]
    d = np.abs(x - at)
    if method == "bilinear":
        return at, 1 - d
    return at, np.where(d <= 1, 1.5 * d**3 - 2.5 * d * d + 1, -0.5 * d**3 + 2.5 * d * d - 4 * d + 2)


def resample(pixels: DataFrame, row_step: float, col_step: float, method: str = "bilinear", tile: int = 64) -> DataFrame:
    """(scene, r, c, v) on a grid whose cells are ``row_step`` x ``col_step`` source cells large, from the same corner.

    Missing or null source cells are left out and the other weights shared anew; without any the value is null.  A source cell
    travels to the tiles of the new grid that it has weight in; the result doesn't depend on ``tile``.
    """
    if method not in REACH:
        raise ValueError(f"unknown method {method}")
    steps, reach = (row_step, col_step), REACH[method]
    sides = [max(1, int(tile / max(1, step))) for step in steps]
    size = pixels.groupBy("scene").agg(*[F.greatest(F.lit(1), F.round((F.max(x) + 1) / step).cast("int")).alias(f"n_{x}") for x, step in zip("rc", steps)])

    def reached(x: str, step: float, side: int) -> Column:
        low, high = (((F.col(x) + d + 0.5) / step - 0.5) for d in (-reach - 1e-6, reach + 1e-6))
        low, high = F.greatest(F.lit(0), F.ceil(low)), F.floor(high)
        tiles = F.sequence(F.floor(low / side).cast("int"), F.floor(high / side).cast("int"))
        return F.explode(F.when(low <= high, tiles).otherwise(F.array().cast("array<int>")))

    own = size
    for x, side in zip("rc", sides):
        own = own.withColumn(f"tile_{x}", F.explode(F.sequence(F.lit(0), F.floor((F.col(f"n_{x}") - 1) / side).cast("int"))))
    cells = pixels.filter("v is not null").withColumn("tile_r", reached("r", row_step, sides[0])).withColumn("tile_c", reached("c", col_step, sides[1]))
    keys, none = ["scene", "tile_r", "tile_c"], F.lit(0)
    cells = cells.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("v").cast("double").alias("v"), none.alias("n_r"), none.alias("n_c"))
    both = cells.union(own.select(*keys, none, none, F.lit(None).cast("double"), "n_r", "n_c"))

    def axis(place: int, n: int, step: float, side: int) -> tuple[int, int, int, np.ndarray, np.ndarray]:
        """A tile's first cell and number of cells, its first source cell, and where its taps lie from there with their weights."""
        first = place * side
        at, weight = _taps((np.arange(first, min(first + side, n)) + 0.5) * step - 0.5, method)
        return first, at.shape[1], int(at.min()), at - at.min(), weight

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        tr, tc, r, c, nr, nc = (t[x].to_numpy() for x in ("tile_r", "tile_c", "r", "c", "n_r", "n_c"))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        mark = np.flatnonzero(nr > 0)
        v = t["v"].to_numpy()
        kinds, alike = np.unique(np.stack([tr[mark], nr[mark], tc[mark], nc[mark]], 1), axis=0, return_inverse=True)
        out = []
        for k, (pr, hr, pc, hc) in enumerate(kinds.tolist()):
            which = mark[alike.ravel() == k]
            (first_r, high, low_r, at_r, w_r), (first_c, wide, low_c, at_c, w_c) = axis(pr, hr, row_step, sides[0]), axis(pc, hc, col_step, sides[1])
            place = np.full(len(starts), -1)
            place[group[which]] = np.arange(len(which))
            shape = (len(which), int(at_r.max()) + 1, int(at_c.max()) + 1)
            near = (nr == 0) & (place[group] >= 0) & (r >= low_r) & (r < low_r + shape[1]) & (c >= low_c) & (c < low_c + shape[2])
            where = (place[group[near]], r[near] - low_r, c[near] - low_c)
            value, there = np.zeros(shape), np.zeros(shape)
            np.add.at(value, where, v[near])
            np.add.at(there, where, 1.0)
            total, used = np.zeros((len(which), high, wide)), np.zeros((len(which), high, wide))
            for a, wa in zip(at_r, w_r):
                for b, wb in zip(at_c, w_c):
                    w = wa[:, None] * wb
                    total += w * value[:, a][:, :, b]
                    used += w * there[:, a][:, :, b]
            some = np.abs(used) > 1e-9
            got = pa.array((total / np.where(some, used, 1.0)).ravel(), mask=~some.ravel())
            rows, cols = np.divmod(np.tile(np.arange(high * wide, dtype=np.int32), len(which)), wide)
            out.append(pa.table({"scene": t["scene"].take(pa.array(np.repeat(which, high * wide))), "r": (first_r + rows).astype(np.int32), "c": (first_c + cols).astype(np.int32), "v": got}))
        return pa.concat_tables(out) if out else pa.table({"scene": t["scene"].slice(0, 0), "r": pa.array([], pa.int32()), "c": pa.array([], pa.int32()), "v": pa.array([], pa.float64())})

    return whole_groups(both, keys, run, f"scene {pixels.schema['scene'].dataType.simpleString()}, r int, c int, v double")


def idw_fill(pixels: DataFrame, k: int = 8, power: float = 2.0, reach: int = 3) -> DataFrame:
    """Null cells get the inverse-distance mean of the k nearest valid cells of their scene (ties by row and column), of fewer
    only where the scene has no more; without any they stay null.

    Cells meet the valid ones of their own and the eight blocks around it.  What lies within one block's side is then known in
    full; cells that have fewer than k there go on to blocks of twice the side (``reach`` at first).
    """
    valid = pixels.filter("v is not null").select("scene", F.col("r").alias("sr"), F.col("c").alias("sc"), "v")
    extent = pixels.agg(F.greatest(F.max("r") - F.min("r"), F.max("c") - F.min("c"))).first()[0] or 0
    todo, filled, side = pixels.filter("v is null").select(*PIXEL), None, max(1, reach)

    def of(x: str) -> Column:
        return F.floor(F.col(x) / side).cast("long")

    while True:
        near = todo.withColumn("dr", F.explode(_near(1))).withColumn("dc", F.explode(_near(1))).select(*PIXEL, (of("r") + F.col("dr")).alias("br"), (of("c") + F.col("dc")).alias("bc"))
        met = near.join(valid.select("*", of("sr").alias("br"), of("sc").alias("bc")), ["scene", "br", "bc"])
        d2 = F.pow(F.col("sr") - F.col("r"), F.lit(2)) + F.pow(F.col("sc") - F.col("c"), F.lit(2))
        met = met.withColumn("d2", d2)
        last = side >= extent
        if not last:
            met = met.filter(F.col("d2") < (side + 1) ** 2)
        place = F.row_number().over(Window.partitionBy(*PIXEL).orderBy("d2", "sr", "sc"))  # k of each part, then k of these: no group is gathered
        found = met.withColumn("place", place).filter(F.col("place") <= k).groupBy(*PIXEL).agg(F.array_sort(F.collect_list(F.struct("d2", "sr", "sc", "v"))).alias("near"))
        found = cut(found if last else found.filter(F.size("near") >= k))
        filled = found if filled is None else filled.union(found)
        if last:
            break
        todo = cut(todo.join(found.select(*PIXEL), PIXEL, "left_anti"))
        if todo.isEmpty():
            break
        side *= 2
    total = "aggregate(near, 0D, (a, e) -> a + {0} * pow(e.d2, {1}))"
    filled = filled.select(*PIXEL, (F.expr(total.format("e.v", -power / 2)) / F.expr(total.format("1", -power / 2))).alias("fill"))
    return pixels.join(filled, PIXEL, "left").withColumn("v", F.coalesce("v", "fill")).drop("fill")


# areas and outlines
def connected_areas(cells: DataFrame, unit_area: float = 1.0, small: int = SMALL) -> DataFrame:
    """(scene, label, cells, area) of the 4-connected areas of ``cells`` (scene, r, c; each once).

    Scenes of at most ``small`` cells are labelled many at a time, larger ones by joins of runs; results are the same.
    """
    few, many = _by_size(cells.select(*PIXEL), small)
    found = whole_groups(few, ["scene"], _labelled, f"{_kinds(few, *PIXEL)}, cells long")
    found = found.select("scene", F.struct("r", "c").alias("label"), "cells", (F.col("cells") * unit_area).alias("area"))
    return found if many is None else found.union(_linked_areas(many, unit_area))


def _labelled(t: pa.Table, starts: np.ndarray) -> pa.Table:
    """First cell and number of cells of each area: the least cell of all reaches the others by minima and jumps."""
    group, r, c = _group_of(t, starts), t["r"].to_numpy(), t["c"].to_numpy()
    r, c = (x - np.minimum.reduceat(x, starts)[group] + 1 for x in (r, c))
    high, wide = (np.maximum.reduceat(x, starts) + 2 for x in (r, c))
    base = np.r_[0, np.cumsum(high.astype(np.int64) * wide)]
    stride = wide[group].astype(np.int64)
    at = base[group] + r * stride + c
    label = np.full(base[-1], base[-1])
    label[at] = at
    while True:
        near = label[at]
        for d in (stride, -stride, 1, -1):
            near = np.minimum(near, label[at + d])
        if (near == label[at]).all():
            break
        np.minimum.at(label, label[at], near)  # the area's first cell so far learns of the better one
        label[at] = np.minimum(label[at], near)
        label[at] = label[label[at]]
    row = np.zeros(base[-1], np.int64)
    row[at] = np.arange(len(at))
    first, n = np.unique(label[at], return_counts=True)
    got = t.select(PIXEL).take(pa.array(row[first]))
    return got.append_column("cells", pa.array(n.astype(np.int64)))


def _linked_areas(cells: DataFrame, unit_area: float) -> DataFrame:
    """``connected_areas`` of any scenes.

    Cells of one row become runs, runs that touch the next row's are linked, and the least run reaches all others by
    repeated minima and jumps; only runs take part in the rounds.
    """
    line = Window.partitionBy("scene", "r").orderBy("c")
    cells = cells.select(*PIXEL).withColumn("run", F.col("c") - F.row_number().over(line))
    cells = cut(cells.withColumn("node", F.struct("scene", F.min("r").over(Window.partitionBy("scene", "r", "run")).alias("r"), F.min("c").over(Window.partitionBy("scene", "r", "run")).alias("c"))).drop("run"))
    below = cells.select("scene", (F.col("r") - 1).alias("r"), "c", F.col("node").alias("b"))
    edges = cells.join(below, PIXEL).select(F.col("node").alias("a"), "b").distinct()
    both = cut(edges.union(edges.select("b", "a")))
    labels = cut(cells.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("far"))
        moved = cut(best.join(up, best.label == up.up).select("node", "was", F.least("label", "far").alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("was <> label").isEmpty():
            break
    sizes = cells.groupBy("node").count().join(labels, "node").groupBy("label").agg(F.sum("count").alias("cells"))
    return sizes.select("label.scene", F.struct("label.r", "label.c").alias("label"), "cells", (F.col("cells") * unit_area).alias("area"))


#: Length of an outline at a border cell, by the sum over its border neighbours (sides 2, corners 10, itself 1).
OUTLINE = {1.0: (5, 7, 15, 17, 25, 27), math.sqrt(2): (21, 33), (1 + math.sqrt(2)) / 2: (13, 23)}


def perimeter(pixels: DataFrame) -> DataFrame:
    """(scene, segment, perimeter): border cells have a side neighbour outside the segment; their lengths are summed."""
    at = pixels.select(*PIXEL, "segment")
    side = at.withColumn("d", F.explode(F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])))
    side = side.select("scene", (F.col("r") + F.col("d.r")).alias("r"), (F.col("c") + F.col("d.c")).alias("c"), "segment", (F.col("d.r") * F.col("d.r") + F.col("d.c") * F.col("d.c") == 0).alias("own"))
    border = side.groupBy(*PIXEL, "segment").agg(F.max("own").alias("own"), F.count("*").alias("n")).filter("own and n < 5").select(*PIXEL, "segment")
    spread = border.withColumn("dr", F.explode(_near(1))).withColumn("dc", F.explode(_near(1)))
    far = F.abs("dr") + F.abs("dc")
    weight = F.when(far == 0, 1).when(far == 1, 2).otherwise(10)
    code = spread.select("scene", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "segment", weight.alias("w"), (far == 0).alias("own"))
    code = code.groupBy(*PIXEL, "segment").agg(F.sum("w").alias("code"), F.max("own").alias("own")).filter("own")
    length = F.lit(0.0)
    for value, codes in OUTLINE.items():
        length = F.when(F.col("code").isin(*codes), value).otherwise(length)
    return code.groupBy("scene", "segment").agg(F.sum(length).alias("perimeter"))


# classes
def _filled(pixels: DataFrame) -> DataFrame:
    """Every cell between the ends of each scene (scene, r, c, v); v is null where the scene has none."""
    size = pixels.groupBy("scene").agg(*[f(x).alias(n) for x in "rc" for f, n in ((F.min, f"{x}0"), (F.max, f"{x}1"))])
    rows = size.select("scene", F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1")
    return rows.select("scene", "r", F.explode(F.sequence("c0", "c1")).alias("c")).join(pixels.select(*PIXEL, "v"), PIXEL, "left")


def _of_three(x: Column, line: Window, mirror: bool) -> Column:
    """Sum of a cell and its two neighbours on a line; beyond an end lies nothing, or what lies on the end's other side."""
    before, after = F.lag(x).over(line), F.lead(x).over(line)
    rest = (after, x), (before, x)
    if not mirror:
        rest = (F.lit(0),), (F.lit(0),)
    return x + F.coalesce(before, *rest[0]) + F.coalesce(after, *rest[1])


def mrf_relabel(pixels: DataFrame, n: int = 2, iterations: int = 200, every: int = 5, mirror: bool = True, small: int = SMALL) -> DataFrame:
    """(scene, r, c, v, label) after ``iterations`` rounds of iterated conditional modes.

    Labels start as equal parts of the scene's value range.  A round weighs each class by the log share of the eight
    neighbours that have it (0 counts as 0.001) and the log density of the value under the class's mean and deviation (at
    least 0.001); the first of equal classes wins.  Beyond an edge lie the cells on its other side, edge cells not repeated
    (a scene of one row or column lies beside itself); without ``mirror`` nothing does.  Null and absent cells take no part: they
    are nobody's neighbours, and the cells on their two sides aren't each other's.

    A round depends on the labels only.  So a scene whose labels are those of two rounds before is left as it is, if an even
    number of rounds is to come.  Scenes of at most ``small`` cells go through all rounds many at a time, larger ones by windows
    and checkpoints; results are the same.
    """
    few, many = _by_size(pixels.filter("scene is not null").select(*PIXEL, "v"), small)

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        label = _modes(t, starts, n, iterations, mirror)
        there = pa.array(label >= 0)
        return t.append_column("label", pa.array(label)).filter(there)

    done = whole_groups(few, ["scene"], run, f"{_kinds(few, *PIXEL, 'v')}, label int")
    return done if many is None else done.union(_windowed_modes(many, n, iterations, every, mirror))


def _modes(t: pa.Table, starts: np.ndarray, n: int, iterations: int, mirror: bool) -> np.ndarray:
    """Labels of the cells of whole scenes, -1 where v is null; scenes of one shape are worked on together."""
    group = _group_of(t, starts)
    there = t["v"].is_valid().to_numpy()
    v = t["v"].cast(pa.float64()).fill_null(0.0).to_numpy()
    r, c = (x - np.minimum.reduceat(x, starts)[group] for x in (t["r"].to_numpy(), t["c"].to_numpy()))
    shapes, alike = np.unique(np.stack([np.maximum.reduceat(x, starts) + 1 for x in (r, c)], 1), axis=0, return_inverse=True)
    alike, out = alike.ravel(), np.full(t.num_rows, -1, np.int32)
    for k, shape in enumerate(shapes.tolist()):
        mine = np.flatnonzero(alike == k)
        place = np.full(len(starts), -1)
        place[mine] = np.arange(len(mine))
        cells = np.flatnonzero(place[group] >= 0)
        where = (place[group[cells]], r[cells], c[cells])
        value, known = np.zeros((len(mine), *shape)), np.zeros((len(mine), *shape), bool)
        value[where], known[where] = v[cells], there[cells]
        out[cells] = _relabelled(value, known, n, iterations, mirror)[where]
    return out


def _beside(x: np.ndarray, axis: int, mirror: bool) -> np.ndarray:
    """Sums of cells and their two neighbours along an axis, as ``_of_three`` has them."""
    mode = {"mode": "constant"} if not mirror else {"mode": "reflect" if x.shape[axis] > 1 else "edge"}
    wide = np.pad(x, [(1, 1) if a == axis else (0, 0) for a in range(3)], **mode)
    a, m, z = (np.take(wide, np.arange(d, d + x.shape[axis]), axis) for d in range(3))
    return a + m + z


def _relabelled(v: np.ndarray, known: np.ndarray, n: int, iterations: int, mirror: bool) -> np.ndarray:
    """``mrf_relabel`` of scenes (scene, row, column); a scene leaves the rounds once its labels are those of two rounds before."""
    low, high = (f(np.where(known, v, x), axis=(1, 2), keepdims=True) for f, x in ((np.min, np.inf), (np.max, -np.inf)))
    with np.errstate(all="ignore"):
        start = np.floor((v - low) * n / (high - low))
    now = np.where(known, np.where(high > low, np.minimum(n - 1, start), 0), -1).astype(np.int32)
    out, active, last = now.copy(), np.arange(len(v)), np.full(v.shape, -2, np.int32)
    around = _beside(_beside(known.astype(np.int16), 2, mirror), 1, mirror) - known
    for turn in range(iterations):
        scores = np.empty((n, *now.shape))
        for k in range(n):
            own = now == k
            near = _beside(_beside(own.astype(np.int16), 2, mirror), 1, mirror) - own
            count = own.sum(axis=(1, 2), keepdims=True)
            with np.errstate(all="ignore"):
                mean = np.where(own, v, 0).sum(axis=(1, 2), keepdims=True) / count
                dev = np.maximum(np.sqrt((np.where(own, v - mean, 0) ** 2).sum(axis=(1, 2), keepdims=True) / count), 0.001)
                share = near / around
                score = np.round(np.log(np.where(share > 0, share, 0.001)) - np.log(dev) - ((v - mean) / dev) ** 2 / 2, 9)
            scores[k] = np.where(count > 0, score, -1e300)
        new = np.where(known, scores.argmax(0), -1).astype(np.int32)
        settled = (new == last).all(axis=(1, 2))
        if settled.any():
            out[active[settled]] = (new if (iterations - turn) % 2 else now)[settled]
            go = ~settled
            active, v, known, around, now, new = (x[go] for x in (active, v, known, around, now, new))
            if not len(active):
                return out
        last, now = now, new
    out[active] = now
    return out


def _windowed_modes(pixels: DataFrame, n: int, iterations: int, every: int, mirror: bool) -> DataFrame:
    """``mrf_relabel`` of any scenes."""
    line, column = Window.partitionBy("scene", "r").orderBy("c"), Window.partitionBy("scene", "c").orderBy("r")
    ends = pixels.groupBy("scene").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    start = F.least(F.lit(n - 1), F.coalesce(F.floor(F.try_divide((F.col("v") - F.col("lo")) * n, F.col("hi") - F.col("lo"))), F.lit(0))).cast("int")
    now = cut(_filled(pixels).join(ends, "scene").select(*PIXEL, "v", F.when(F.col("v").isNotNull(), start).alias("label"), F.lit(-1).alias("last")))
    settled = []
    own = {f"{k}": F.coalesce((F.col("label") == k).cast("int"), F.lit(0)) for k in range(n)} | {"n": F.col("label").isNotNull().cast("int")}
    for turn in range(iterations):
        stats = now.groupBy("scene").agg(*[f(F.when(F.col("label") == k, F.col("v"))).alias(f"{s}{k}") for k in range(n) for s, f in (("m", F.avg), ("s", F.stddev_pop))])
        x = now.withColumns({f"o{k}": v for k, v in own.items()})
        x = x.withColumns({f"t{k}": _of_three(F.col(f"o{k}"), line, mirror) for k in own})
        x = x.withColumns({f"n{k}": _of_three(F.col(f"t{k}"), column, mirror) - F.col(f"o{k}") for k in own})
        x = x.join(stats, "scene")
        scores = []
        for k in range(n):
            share, dev = F.try_divide(F.col(f"n{k}"), F.col("nn")), F.greatest(F.col(f"s{k}"), F.lit(0.001))
            prior = F.log(F.when(share > 0, share).otherwise(0.001))
            density = -F.log(dev) - F.pow((F.col("v") - F.col(f"m{k}")) / dev, 2) / 2
            scores.append(F.struct(F.coalesce(F.round(prior + density, 9), F.lit(-1e300)).alias("score"), F.lit(-k).alias("k")))
        best = F.greatest(*scores) if n > 1 else scores[0]
        now = x.select(*PIXEL, "v", F.when(F.col("v").isNotNull(), -best["k"]).alias("label"), F.col("label").alias("last"), F.col("last").alias("before"))
        if turn % every == every - 1:
            now = cut(now)
            if (iterations - turn) % 2 == 1:
                moving = now.filter("label <> before").select("scene").distinct()
                settled.append(now.join(moving, "scene", "left_anti"))
                now = cut(now.join(moving, "scene", "left_semi"))
                if now.isEmpty():
                    break
    return reduce(DataFrame.union, [part.select(*PIXEL, "v", "label") for part in [*settled, now]]).filter("v is not null")


def superpixels(pixels: DataFrame, step: int, compactness: float = 10.0, iterations: int = 10, small: int = SMALL) -> DataFrame:
    """(scene, r, c, v, sr, sc): each cell joins the nearest of the centres of its own and the eight neighbouring seed cells, by
    value and, weighted with (compactness / step) squared, place; centres move to their members' means.  Ties by seed.

    Scenes of at most ``small`` cells go through all rounds many at a time, larger ones by joins; results are the same."""
    few, many = _by_size(pixels.filter("v is not null").select(*PIXEL, "v"), small)

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        sr, sc = _clustered(t, starts, step, (compactness / step) ** 2, iterations)
        return t.append_column("sr", pa.array(sr)).append_column("sc", pa.array(sc))

    done = whole_groups(few, ["scene"], run, f"{_kinds(few, *PIXEL, 'v')}, sr int, sc int")
    return done if many is None else done.union(_joined_superpixels(many, step, compactness, iterations))


def _clustered(t: pa.Table, starts: np.ndarray, step: int, weight: float, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the cells of whole scenes; each scene's seeds have a rim of empty ones."""
    group, r, c, v = _group_of(t, starts), t["r"].to_numpy(), t["c"].to_numpy(), t["v"].cast(pa.float64()).to_numpy()
    own = [np.trunc(x / step).astype(np.int64) for x in (r, c)]
    least = [np.minimum.reduceat(x, starts) - 1 for x in own]
    place = [x - low[group] for x, low in zip(own, least)]
    high, wide = (np.maximum.reduceat(x, starts) + 2 for x in place)
    base = np.r_[0, np.cumsum(high * wide)]
    home = base[group] + place[0] * wide[group] + place[1]
    seed = home
    for _ in range(iterations):
        count = np.bincount(seed, minlength=base[-1])
        with np.errstate(all="ignore"):
            mr, mc, mv = (np.bincount(seed, weights=x, minlength=base[-1]) / count for x in (r, c, v))
        best, seed = np.full(len(v), np.inf), home.copy()
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                at = home + dr * wide[group] + dc
                d = np.round((v - mv[at]) ** 2 + weight * ((r - mr[at]) ** 2 + (c - mc[at]) ** 2), 9)
                better = (count[at] > 0) & (d < best)
                best[better], seed[better] = d[better], at[better]
    found = np.divmod(seed - base[group], wide[group])
    return tuple((x + low[group]).astype(np.int32) for x, low in zip(found, least))


def _joined_superpixels(pixels: DataFrame, step: int, compactness: float, iterations: int) -> DataFrame:
    """``superpixels`` of any scenes."""
    weight = (compactness / step) ** 2
    base = pixels.filter("v is not null").select(*PIXEL, "v", F.expr(f"r div {step}").cast("int").alias("sr"), F.expr(f"c div {step}").cast("int").alias("sc"))
    now = base
    for turn in range(iterations):
        centre = now.groupBy("scene", "sr", "sc").agg(F.avg("r").alias("mr"), F.avg("c").alias("mc"), F.avg("v").alias("mv"))
        # a seed cell gets the nine centres about it, so cells travel once and not nine times
        own = centre.withColumn("dr", F.explode(_near(1))).withColumn("dc", F.explode(_near(1))).select("scene", (F.col("sr") + F.col("dr")).alias("hr"), (F.col("sc") + F.col("dc")).alias("hc"), F.struct("sr", "sc", "mr", "mc", "mv").alias("e"))
        near = own.groupBy("scene", "hr", "hc").agg(F.collect_list("e").alias("near")).select("scene", F.col("hr").alias("sr"), F.col("hc").alias("sc"), "near")

        def far(e: Column) -> Column:
            d = F.pow(F.col("v") - e["mv"], 2) + weight * (F.pow(F.col("r") - e["mr"], 2) + F.pow(F.col("c") - e["mc"], 2))
            return F.struct(F.round(d, 9).alias("d"), e["sr"].alias("sr"), e["sc"].alias("sc"))

        best = base.join(near, ["scene", "sr", "sc"]).select(*PIXEL, "v", F.array_min(F.transform("near", far)).alias("k"))
        now = best.select(*PIXEL, "v", "k.sr", "k.sc")
        if turn % 5 == 4:
            now = cut(now)
    return now
