"""Kernels over tiles of a scene: each tile gets a halo of its neighbours' cells and is worked on in one Arrow batch."""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def haloed(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """``cells`` (with r, c), each once for every tile (tile_r, tile_c of ``tile`` cells a side) within ``halo`` cells."""

    def tiles(x: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(x) - halo) / tile).cast("int"), F.floor((F.col(x) + halo) / tile).cast("int")))

    return cells.withColumn("tile_r", tiles("r")).withColumn("tile_c", tiles("c"))


def shift(distance: float, angle: float) -> tuple[int, int]:
    """Rows and columns from a cell to its partner: ``angle`` in degrees, counted from the right towards the top."""
    dx, dy = distance * math.cos(math.radians(angle)), -distance * math.sin(math.radians(angle))
    return math.floor(dy + 0.5), math.floor(dx + 0.5)


def _mirrored(at: np.ndarray, top: int) -> np.ndarray:
    """Indexes outside 0..top mirrored at the edge cells, which aren't repeated."""
    if not top:
        return np.zeros_like(at)
    at = at % (2 * top)
    return np.where(at > top, 2 * top - at, at)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a table that is sorted by ``keys`` start."""
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for k in keys:
        x = t[k].combine_chunks()
        null, other = x.is_null().to_numpy(zero_copy_only=False), pc.not_equal(x[1:], x[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        new[1:] |= other | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def whole_groups(df: DataFrame, keys: list[str], kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, rows: int = 1 << 16) -> DataFrame:
    """``kernel`` of the groups of ``keys``, many small ones at a time: it gets a table sorted by ``keys`` and where its groups start.  A
    task holds about ``rows`` rows, or one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            t = pa.Table.from_batches(held)
            starts = _starts(t, keys)
            if len(starts) > 1:
                yield from kernel(t.slice(0, starts[-1]).combine_chunks(), starts[:-1]).to_batches(rows)
                held, n = t.slice(starts[-1]).to_batches(), n - int(starts[-1])
        if n:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from kernel(t, _starts(t, keys)).to_batches(rows)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


#: Window cells that are sorted at once, about.
AT_ONCE = 1 << 22


class _Windows:
    """Level pairs counted in the k x k windows of tiles that come with ``halo`` cells about them."""

    def __init__(self, levels: int, k: int, step: tuple[int, int], tile: int, halo: int = 0):
        self.levels, self.k, self.step, self.tile = levels, k, step, tile
        self.halo = max(halo, k // 2 + max(map(abs, step)))

    def _axis(self, first: int, top: int, step: int) -> tuple:
        """Along one axis of a tile: cells before it, cells in all, its own cells, and where partners and windows' cells lie."""
        last, low = min(first + self.tile - 1, top), max(0, first - self.halo)
        n, half = min(top, last + self.halo) - low + 1, self.k // 2
        partner = np.clip(np.clip(np.arange(low, low + n) + step, 0, top) - low, 0, n - 1)
        seen = _mirrored(np.arange(first - half, last + self.k - half), top) - low
        return first - low, n, last - first + 1, tuple(partner.tolist()), tuple(seen.tolist())

    def count(self, t: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Tile's first row in the table, r, c, i, j and n, in order of the cells of each tile; tiles alike are counted together."""
        r, c, level = (t[x].to_numpy() for x in ("r", "c", "level"))
        ends = np.append(starts[1:], t.num_rows)
        at = np.stack([t[x].to_numpy()[starts] for x in ("tile_r", "top_r", "tile_c", "top_c")], 1)
        kinds, alike = np.unique(at, axis=0, return_inverse=True)
        shapes: dict[tuple, list[int]] = {}
        for i, (tr, pr, tc, pc_) in enumerate(kinds.tolist()):
            shapes.setdefault((self._axis(tr * self.tile, pr, self.step[0]), self._axis(tc * self.tile, pc_, self.step[1])), []).append(i)
        kind, small = np.int16 if self.levels**2 < 1 << 15 else np.int64, self.k * self.k
        for (down, along), which in shapes.items():
            (before_r, rows, high, partner_r, seen_r), (before_c, cols, wide, partner_c, seen_c) = down, along
            mine = np.flatnonzero(np.isin(alike.ravel(), which))
            many = max(1, AT_ONCE // (high * wide * small))
            for part in (mine[x : x + many] for x in range(0, len(mine), many)):
                size = ends[part] - starts[part]
                cells = np.repeat(starts[part] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                which_tile = np.repeat(np.arange(len(part)), size)
                first_r, first_c = at[part, 0] * self.tile, at[part, 2] * self.tile
                a = np.full((len(part), rows, cols), -1, np.int64)
                a[which_tile, r[cells] - first_r[which_tile] + before_r, c[cells] - first_c[which_tile] + before_c] = level[cells]
                b = a[:, list(partner_r)][:, :, list(partner_c)]
                code = np.where((a >= 0) & (b >= 0), a * self.levels + b, -1).astype(kind)
                view = np.lib.stride_tricks.sliding_window_view(code[:, list(seen_r)][:, :, list(seen_c)], (self.k, self.k), axis=(1, 2))
                flat = np.sort(view.reshape(-1, small), axis=1)
                new = np.ones(flat.shape, bool)
                new[:, 1:] = flat[:, 1:] != flat[:, :-1]
                found = np.flatnonzero(new)
                n, pair, cell = np.diff(np.append(found, flat.size)), flat.ravel()[found], found // small
                real = pair >= 0
                n, pair, cell = n[real], pair[real].astype(np.int64), cell[real]
                tile, cell = np.divmod(cell, high * wide)
                yield starts[part][tile], first_r[tile] + cell // wide, first_c[tile] + cell % wide, pair // self.levels, pair % self.levels, n


def _levelled(pixels: DataFrame, levels: int) -> DataFrame:
    size = pixels.groupBy("scene").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("r").cast("int").alias("top_r"), F.max("c").cast("int").alias("top_c"))
    level = F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") + 1 - F.col("lo")) / levels)).cast("int")
    return pixels.filter("v is not null").join(size, "scene").select("scene", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), level.alias("level"), "top_r", "top_c")


def _tiled(pixels: DataFrame, levels: int, tile: int, halo: int) -> DataFrame:
    """Levels in tiles with halos, without those that lie beyond the scene."""
    return haloed(_levelled(pixels, levels), tile, halo).filter(f"tile_r between 0 and top_r div {tile} and tile_c between 0 and top_c div {tile}")


_TILE = ["scene", "tile_r", "tile_c"]


def cooccurrences(pixels: DataFrame, levels: int, k: int, pairs: dict[str, tuple[float, float]], tile: int = 64) -> DataFrame:
    """(pair, scene, r, c, i, j, n): for each name of ``pairs`` (distance and angle) how often level i has level j there (partners beyond the
    scene are the edge cells) in the k x k window about each cell, whose border is mirrored without repeating the edge.

    Rows and columns count from 0; cells that are null or absent take part in no pair.  The result doesn't depend on
    ``tile``.  Cells travel once for all pairs."""
    steps = {name: shift(*at) for name, at in pairs.items()}
    halo = k // 2 + max(abs(x) for step in steps.values() for x in step)
    ways = {name: _Windows(levels, k, step, tile, halo) for name, step in steps.items()}
    kind = pixels.schema["scene"].dataType.simpleString()

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for name, w in ways.items():
            for at, r, c, i, j, n in w.count(t, starts):
                ints = {x: v.astype(np.int32) for x, v in (("r", r), ("c", c), ("i", i), ("j", j))}
                out.append(pa.table({"pair": pa.repeat(name, len(n)), "scene": t["scene"].take(pa.array(at)), **ints, "n": n.astype(np.int64)}))
        return pa.concat_tables(out)

    return whole_groups(_tiled(pixels, levels, tile, halo), _TILE, run, f"pair string, scene {kind}, r int, c int, i int, j int, n long")


def cooccurrence(pixels: DataFrame, levels: int, k: int, distance: float = 1.0, angle: float = 0.0, tile: int = 64) -> DataFrame:
    """(scene, r, c, i, j, n): ``cooccurrences`` at one ``distance`` and ``angle``."""
    return cooccurrences(pixels, levels, k, {"": (distance, angle)}, tile).drop("pair")


TEXTURES = ("max", "entropy", "mean", "std", "contrast", "dissimilarity", "homogeneity", "asm", "energy")


def textures(pixels: DataFrame, levels: int, k: int, distance: float = 1.0, angle: float = 0.0, tile: int = 64) -> DataFrame:
    """Nine texture values of each cell, of the counts of ``cooccurrence``, which don't leave their tile; empty level pairs enter
    entropy and deviation in closed form."""
    w, cells, base = _Windows(levels, k, shift(distance, angle), tile), levels * levels, 1 / (k * k)
    kind = pixels.schema["scene"].dataType.simpleString()

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        return pa.concat_tables([of_tiles(t, *counted) for counted in w.count(t, starts)])

    def of_tiles(t: pa.Table, at: np.ndarray, r: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> pa.Table:
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (r[1:] != r[:-1]) | (c[1:] != c[:-1])]) if len(r) else np.zeros(0, np.int64)

        def total(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, new) if len(new) else np.zeros(0)

        p, d = n * base + base, np.abs(i - j)
        mean, asm = total(n * i) / cells, total(n * n).astype(float)
        entropy = total(-p * np.log(p)) + (cells - np.diff(np.append(new, len(r)))) * (-base * math.log(base))
        std = np.sqrt(np.maximum(0, total((n * i) ** 2) - cells * mean * mean))
        top = np.maximum.reduceat(n, new) if len(new) else n
        values = (top.astype(np.int64), entropy, mean, std, total(n * d * d).astype(float), total(n * d).astype(float), total(n / (1 + d * d)), asm, np.sqrt(asm))
        return pa.table({"scene": t["scene"].take(pa.array(at[new])), "r": r[new].astype(np.int32), "c": c[new].astype(np.int32), **dict(zip(TEXTURES, values))})

    schema = f"scene {kind}, r int, c int, max long, " + ", ".join(f"{x} double" for x in TEXTURES[1:])
    return whole_groups(_tiled(pixels, levels, tile, w.halo), _TILE, run, schema)


def radial_fill(pixels: DataFrame, tile: int = 32, halo: int = 8, epsilon: float | None = None) -> DataFrame:
    """(scene, r, c, v): null cells from the valid cells of their tile and its halo, by inverse multiquadrics 1 / sqrt(1 + (d / epsilon)^2)
    whose sum meets all of these cells.

    ``epsilon``: by default the mean spacing of the scene's valid cells, (height x width / number) ** (1 / 2), where a side of
    length 0 doesn't count.  With a halo as large as the scene the whole scene is solved at once and ``tile`` changes nothing;
    otherwise a system has at most (tile + 2 halo)^2 cells.  Tiles without valid cells, or with a singular system (as by
    repeated cells), stay unfilled."""
    valid, holes = pixels.filter("v is not null").select("scene", "r", "c", F.col("v").cast("double").alias("v")), pixels.filter("v is null").select("scene", "r", "c")
    high, wide = ((F.max(x) - F.min(x)).cast("double") for x in ("r", "c"))
    size = valid.groupBy("scene").agg(high.alias("h"), wide.alias("w"), F.count("*").alias("n"))
    area = F.when(F.col("h") > 0, F.col("h")).otherwise(1.0) * F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)
    sides = (F.col("h") > 0).cast("int") + (F.col("w") > 0).cast("int")
    spacing = F.lit(epsilon) if epsilon else F.when(sides > 0, F.pow(area / F.col("n"), 1 / sides)).otherwise(1.0)
    own = haloed(holes, tile, 0).join(size.select("scene", spacing.alias("epsilon")), "scene", "left")
    parts = ["scene", "tile_r", "tile_c"]
    near = haloed(valid, tile, halo).join(own.select(*parts).distinct(), parts, "left_semi")
    both = own.withColumn("v", F.lit(None).cast("double")).unionByName(near.withColumn("epsilon", F.lit(None).cast("double")))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        at = np.stack([t[x].to_numpy() for x in ("r", "c")], 1).astype(float)
        v = t["v"].to_numpy()
        hole = np.isnan(v)
        known, wanted = at[~hole], at[hole]
        fill, scale = np.full(len(wanted), np.nan), np.nanmax(t["epsilon"].to_numpy()) if len(known) else 1.0

        def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return 1 / np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1) / scale**2 + 1)

        try:
            if len(known):
                fill = kernel(wanted, known) @ np.linalg.solve(kernel(known, known), v[~hole])
        except np.linalg.LinAlgError:
            pass
        return pa.table({"scene": pa.repeat(key[0], len(wanted)), "r": wanted[:, 0].astype(np.int32), "c": wanted[:, 1].astype(np.int32), "v": pa.array(fill, mask=~np.isfinite(fill))})

    kind = pixels.schema["scene"].dataType.simpleString()
    filled = both.groupBy(*parts).applyInArrow(run, f"scene {kind}, r int, c int, v double")
    return valid.select("scene", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v").union(filled)
