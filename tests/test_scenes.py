"""Tiles with halos, edges, gaps, covers, sketches, draws and nulls against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.functions import scalars as s
from airgrid.operators import grid as g
from airgrid.operators import models as m
from airgrid.operators import regions as x
from airgrid.operators import tiles as t
from airgrid.sources.tables import tile_to_pixels, write_layers

SCHEMA = "scene string, r int, c int, v double"


def cells(spark, *grids):
    return spark.createDataFrame([(f"s{k}", r, c, None if v is None else float(v)) for k, grid in enumerate(grids) for r, row in enumerate(grid) for c, v in enumerate(row)], SCHEMA)


def holey(rows, cols, seed, share=0.2):
    rng = random.Random(seed)
    return [[None if rng.random() < share else rng.randrange(9) for _ in range(cols)] for _ in range(rows)]


def pairs(grid, levels, k, dr, dc):
    h, w = len(grid), len(grid[0])
    known = [v for row in grid for v in row if v is not None]
    lo, hi = min(known), max(known)
    level = [[None if v is None else int((v - lo) // ((hi + 1 - lo) / levels)) for v in row] for row in grid]
    clamp = lambda a, n: max(0, min(n - 1, a))

    def mirror(a, n):
        while not 0 <= a < n:
            a = 0 if n == 1 else -a if a < 0 else 2 * (n - 1) - a
        return a

    out = collections.Counter()
    for r in range(h):
        for c in range(w):
            for a in range(r - k // 2, r - k // 2 + k):
                for b in range(c - k // 2, c - k // 2 + k):
                    y, z = mirror(a, h), mirror(b, w)
                    i, j = level[y][z], level[clamp(y + dr, h)][clamp(z + dc, w)]
                    if i is not None and j is not None:
                        out[r, c, i, j] += 1
    return out


@pytest.mark.parametrize("tile,distance,angle,k", [(3, 1, 0, 3), (4, 2, 45, 5), (64, 1, 90, 4), (5, 1.5, 135, 3), (2, 2, 180, 5)])
def test_pairs_of_levels(spark, tile, distance, angle, k):
    grids = holey(11, 7, 1), holey(1, 9, 2, 0), holey(6, 2, 3)
    dr, dc = t.shift(distance, angle)
    assert (dr, dc) == {0: (0, 1), 45: (-1, 1), 90: (-1, 0), 135: (-1, -1), 180: (0, -2)}[angle]
    d = cells(spark, *grids)
    got = {(q.scene, q.r, q.c, q.i, q.j): q.n for q in t.cooccurrence(d, 4, k, distance, angle, tile).collect()}
    assert got == {(f"s{n}", *key): v for n, grid in enumerate(grids) for key, v in pairs(grid, 4, k, dr, dc).items()}
    assert t.cooccurrence(d.filter("v is null"), 4, k).count() == 0


def test_textures_are_those_of_the_counts(spark):
    d = cells(spark, holey(9, 8, 4), holey(5, 5, 5))
    whole = {(q.scene, q.r, q.c): tuple(q)[3:] for q in t.textures(d, 6, 5, 1, 45, tile=4).collect()}
    want = {(q.scene, q.r, q.c): tuple(q)[3:] for q in g.texture(t.cooccurrence(d, 6, 5, 1, 45), 6, 5).select("scene", "r", "c", *t.TEXTURES).collect()}
    assert whole.keys() == want.keys() and all(whole[k] == pytest.approx(want[k]) for k in want)


def solved(grid):
    known = [(r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None]
    at = np.array([q[:2] for q in known], float)
    sides = [e for e in np.ptp(at, axis=0) if e]
    eps = (np.prod(sides) / len(at)) ** (1 / len(sides)) if sides else 1.0
    phi = lambda a, b: 1 / np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1) / eps**2 + 1)
    w = np.linalg.solve(phi(at, at), np.array([q[2] for q in known], float))
    return {(r, c): float(v) if v is not None else float(phi(np.array([[r, c]], float), at)[0] @ w) for r, row in enumerate(grid) for c, v in enumerate(row)}


def test_radial_fill(spark):
    grids = holey(9, 7, 6), holey(1, 8, 7), [[1, None]], [[None, None]]
    d = cells(spark, *grids)
    for tile in (3, 50):
        got = {(q.scene, q.r, q.c): q.v for q in t.radial_fill(d, tile, halo=20).collect()}
        assert len(got) == 9 * 7 + 8 + 4 and got["s3", 0, 0] is None
        for k, grid in enumerate(grids[:3]):
            for at, v in solved(grid).items():
                assert got[(f"s{k}", *at)] == pytest.approx(v, abs=1e-8)
    twice = cells(spark, [[1, 2, None]]).union(cells(spark, [[1]]))
    assert {(q.c, q.v) for q in t.radial_fill(twice).collect()} == {(0, 1.0), (1, 2.0), (2, None)}
    near = t.radial_fill(cells(spark, [[1] + [None] * 40]), 8, halo=2).filter("v is not null").count()
    assert near == 8 and t.radial_fill(d.limit(0)).count() == 0


def test_haar_of_odd_grids(spark):
    three = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    five = [[r * 5 + c for c in range(5)] for r in range(5)]
    one = {(q.scene, q.r, q.c): q.v for q in g.haar_approx(cells(spark, three, five, [[1], [1], [1]]), 1).collect()}
    assert [one["s0", r, c] for r in range(2) for c in range(2)] == [6, 9, 15, 18]
    assert one["s2", 0, 0] == 2 and one["s2", 1, 0] == 2
    assert one["s1", 2, 2] == 2 * 24 and one["s1", 0, 2] == 4 + 9
    two = {(q.scene, q.r, q.c): q.v for q in g.haar_approx(cells(spark, three, five), 2).collect()}
    assert two["s0", 0, 0] == (6 + 9 + 15 + 18) / 2 and len(two) == 1 + 4
    assert two["s1", 1, 1] == 4 * 48 / 2


def relabelled(grid, rounds):
    h, w = len(grid), len(grid[0])
    v = {(r, c): grid[r][c] for r in range(h) for c in range(w) if grid[r][c] is not None}
    lo, hi = min(v.values()), max(v.values())
    label = {k: min(1, int((q - lo) * 2 // (hi - lo))) for k, q in v.items()}
    mirror = lambda a, n: 0 if n == 1 else -a if a < 0 else 2 * (n - 1) - a if a >= n else a
    for _ in range(rounds):
        stats = []
        for k in (0, 1):
            own = np.array([v[q] for q in v if label[q] == k], float)
            stats.append((own.mean(), max(own.std(), 0.001)) if len(own) else None)
        new = {}
        for (r, c), q in v.items():
            near = [label[p] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b for p in [(mirror(r + a, h), mirror(c + b, w))] if p in label]
            score = []
            for k in (0, 1):
                share = near.count(k) / len(near) if near.count(k) else 0.001
                score.append(-1e300 if stats[k] is None else round(math.log(share) - math.log(stats[k][1]) - ((q - stats[k][0]) / stats[k][1]) ** 2 / 2, 9))
            new[r, c] = int(score[1] > score[0])
        label = new
    return label


def test_relabelling_of_scenes_with_gaps(spark):
    grids = holey(9, 8, 8, 0.25), holey(1, 12, 9, 0.2), holey(7, 2, 10, 0.3)
    d = cells(spark, *grids).filter("not (v is null and (r + c) % 2 = 0)")  # some holes are null, others absent
    got = {(q.scene, q.r, q.c): q.label for q in x.mrf_relabel(d, 2, 3).collect()}
    assert got == {(f"s{k}", *at): v for k, grid in enumerate(grids) for at, v in relabelled(grid, 3).items()}
    assert got != {(q.scene, q.r, q.c): q.label for q in x.mrf_relabel(d, 2, 3, mirror=False).collect()}


def test_absent_cells_are_no_neighbours(spark):
    d = spark.createDataFrame([("s", 0, 0, 1.0), ("s", 0, 2, 5.0), ("s", 1, 0, 3.0)], SCHEMA)
    assert {(q.r, q.c): q.eddy for q in g.eddy(d).collect()} == {(0, 0): 0, (0, 2): 0, (1, 0): 0.5}
    edge = {(q.r, q.c): q.edge for q in g.boundary(d.withColumnRenamed("v", "segment")).collect()}
    assert edge == {(0, 0): True, (0, 2): False, (1, 0): False}


def test_scenes_of_other_origins(spark):
    scenes = spark.createDataFrame([("a", 10.0, 0.5, 20.0, -0.5, 4, 4), ("b", 11.01, 0.5, 20.5, -0.5, 4, 3), ("far", 90.0, 0.5, 20.0, -0.5, 4, 4), ("fine", 10.0, 0.25, 20.0, -0.5, 4, 4)], "scene string, t0 double, t1 double, t3 double, t5 double, n_rows int, n_cols int")
    pixels = spark.createDataFrame([(n, r, c, float(100 * k + 10 * r + c)) for k, n in enumerate(("a", "b", "far", "fine")) for r in range(6) for c in range(5)], SCHEMA)
    pairs = spark.createDataFrame([("ab", "a", "b"), ("ba", "b", "a"), ("far", "a", "far"), ("fine", "a", "fine"), ("none", "a", "zz")], "pair string, a string, b string")
    got = {(q.pair, q.r, q.c): (round(q.lon, 6), round(q.lat, 6), q["diff"]) for q in g.scene_diff(pairs, scenes, pixels).collect()}
    # b lies two columns to the right and one row higher
    assert got.keys() == {(p, r, c) for p in ("ab", "ba") for r in range(3) for c in range(2)}
    for r in range(3):
        for c in range(2):
            assert got["ab", r, c] == (10 + (c + 2) * 0.5, 20 - r * 0.5, (10 * r + c + 2) - (100 + 10 * (r + 1) + c))
            assert got["ba", r, c][2] == -got["ab", r, c][2]


def inside(ring, lon, lat):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        hit ^= (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
    return hit


def test_polygons_are_split_and_their_insides_need_no_edges(spark):
    rng = random.Random(2)
    star = [(5 + (4 if k % 2 else 1.7) * math.cos(k * math.pi / 40), 5 + (4 if k % 2 else 1.7) * math.sin(k * math.pi / 40)) for k in range(80)]
    rings = {"star": star, "box": [(-3.3, -3.3), (6.7, -3.3), (6.7, 2.2), (-3.3, 2.2)], "bow": [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)], "none": None, "empty": [], "dot": [(1.0, 1.0)]}
    polygons = spark.createDataFrame(list(rings.items()) + [("box", rings["box"])], "zone string, ring array<struct<x:double,y:double>>")
    at = [(k, rng.uniform(-4, 10), rng.uniform(-4, 10)) for k in range(1500)]
    points = spark.createDataFrame(at + [(-1, None, 1.0), (-2, 1.0, None)], "id int, lon double, lat double")
    want = collections.Counter((k, z) for k, lon, lat in at for z, ring in [*rings.items(), ("box", rings["box"])] if ring and inside(ring, lon, lat))
    for bucket in (0.3, 1.0, 50.0):
        assert collections.Counter((q.id, q.zone) for q in g.clip(points, polygons, bucket).collect()) == want
    parts = g.cover(polygons.limit(6), 0.3).collect()
    assert sum(q.whole for q in parts) > 100 and all(q.edges is None for q in parts if q.whole)
    assert max(len(q.edges) for q in parts if not q.whole) < 40


def test_sketches_merge(spark):
    d = spark.range(60_000).select((F.col("id") % 7).alias("station"), (F.col("id") % 30).alias("day"), F.when(F.col("id") % 11 > 0, F.col("id") % 20_000).alias("item"))
    days = g.distinct_sketches(d, ["station", "day"], F.col("item"))
    exact = {q.station: q.n for q in d.groupBy("station").agg(F.countDistinct("item").alias("n")).collect()}
    got = {q.station: q.n for q in g.merge_sketches(days, ["station"]).collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - n) <= 0.03 * n for k, n in exact.items())
    assert g.merge_sketches(days, []).first().n == pytest.approx(20_000, rel=0.03)


def test_totals_and_null_keys_differ(spark):
    d = spark.createDataFrame([("a", None, 1.0), ("a", "x", 3.0), (None, "x", 5.0)], "station string, variable string, value double")
    got = {(q.station, q.variable, q.grouping): (q.n, q.value) for q in g.grouped_report(d, [("station", "variable"), ("station",), ()]).collect()}
    assert got[None, None, 3] == (3, 3.0) and got["a", None, 0] == (1, 1.0) and got["a", None, 1] == (2, 2.0) and got[None, None, 1] == (1, 5.0)


def test_draws(spark):
    ranges = {"maxIter": range(700, 1400), "maxDepth": range(1, 20)}
    some = m.draw(ranges, 30, 7)
    assert len({tuple(q.items()) for q in some}) == 30 and some == m.draw(ranges, 30, 7) != m.draw(ranges, 30, 8)
    assert all(q["maxIter"] in ranges["maxIter"] and q["maxDepth"] in ranges["maxDepth"] for q in some)
    assert len(m.draw({"a": range(10**9), "b": range(10**9)}, 5, 1)) == 5
    assert sorted(q["a"] for q in m.draw({"a": [1, 2, 3]}, 30, 1)) == [1, 2, 3]


def test_random_search_beats_the_mean(spark):
    rng = np.random.default_rng(5)
    q = rng.normal(size=(120, 2))
    d = spark.createDataFrame([(i, float(a), float(b), float(a * 2 + (b > 0))) for i, (a, b) in enumerate(q)], "id long, a double, b double, y double").coalesce(1)
    best = m.search_random(d.filter("id < 90"), ["a", "b"], "y", {"maxIter": range(1, 6), "maxDepth": range(1, 4)}, draws=3, folds=2)
    left = best.transform(d.filter("id >= 90")).select("y", "prediction").collect()
    y = np.array([r.y for r in left])
    assert len(best.avgMetrics) == 3 and ((y - [r.prediction for r in left]) ** 2).mean() < y.var() / 2


def test_neighbours_of_a_null_feature(spark):
    train = spark.createDataFrame([(1, [0.0], 1.0), (2, [None], 9.0), (3, None, 9.0)], "id long, x array<double>, y double")
    test = spark.createDataFrame([(1, [0.1]), (2, [None]), (3, None)], "id long, x array<double>")
    assert {q.id: q.prediction for q in m.knn_regress(train, test, 2).collect()} == {1: 1.0, 2: None, 3: None}


def test_nulls_stay_null(spark, tmp_path):
    d = spark.createDataFrame([("v", "2024-01-01", 0, c, v) for c, v in enumerate((None, -5.0, 300.0, 70000.0))], "variable string, date string, row int, col int, value double")
    for kind, want in (("byte", [None, 0, 255, 255]), ("uint16", [None, 0, 300, 65535]), ("float32", [None, -5.0, 300.0, 70000.0])):
        write_layers(d, str(tmp_path / kind), kind)
        assert [q.value for q in spark.read.parquet(str(tmp_path / kind)).orderBy("col").collect()] == want
    q = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (3.0, None)], "a double, k double")
    assert {(r.a, r.k) for r in g.min_max(q, ["a", "k"], F.lit(True)).collect()} == {(0.0, 0.0), (None, 0.0), (1.0, None)}
    one, none = F.lit(1.0), F.lit(None).cast("double")
    for args in [[one] * i + [none] + [one] * (3 - i) for i in range(4)]:
        assert spark.range(1).select(s.haversine(*args), s.scattering_angle(*args), s.scattering_angle(*args, legacy=True)).first()[:] == (None, None, None)


def test_names(spark):
    paths = ["/a/b.c/GF1_20240230_x.tar.gz", "C:\\d\\.hidden", "plain", "/a/2024010199_q.tif", "", None]
    d = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    p = F.col("p")
    got = [tuple(r) for r in d.orderBy("i").select(s.base_name(p), s.extension(p), s.name_has(p, "GF1", "_x", ".gz"), s.date_in(p).cast("string")).collect()]
    assert got[0] == ("GF1_20240230_x.tar", ".gz", True, None) and got[1][0] == ".hidden" and got[2] == ("plain", "", False, None)
    assert got[3] == ("2024010199_q", ".tif", False, "2024-01-01") and got[4] == ("", "", False, None) and got[5] == (None, None, None, None)
    w = spark.createDataFrame([("POINT (1.5 -2)",), (" point(3e2   4 ) ",), ("POINT EMPTY",), ("POINT (1 2 3)",), (None,)], "w string")
    assert [tuple(r) for r in w.select(*s.point_of(F.col("w"))).collect()] == [(1.5, -2.0), (300.0, 4.0), (None, None), (None, None), (None, None)]


def test_cells_of_tiles(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0, None, 4.0, 5.0, 6.0]), (2, None), (3, [])], "scene int, data array<double>")
    assert {(q.scene, q.r, q.c): q.v for q in tile_to_pixels(d, 3).collect()} == {(1, 0, 0): 1, (1, 0, 1): 2, (1, 0, 2): None, (1, 1, 0): 4, (1, 1, 1): 5, (1, 1, 2): 6}


@pytest.mark.parametrize("n,dims,k", [(700, 2, 5), (300, 8, 1), (90, 3, 120)])
def test_candidates_hold_the_nearest(spark, n, dims, k):
    from airgrid.operators.match import candidates

    rng = np.random.default_rng(n)
    a, b = np.round(rng.normal(size=(50, dims)), 2), np.round(rng.normal(size=(n, dims)) * rng.choice([0.1, 1, 3], n)[:, None], 2)
    b[: n // 3] = b[0]  # a third in one place
    left = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "i long, x array<double>").repartition(3)
    right = spark.createDataFrame([(j, y.tolist(), f"v{j}") for j, y in enumerate(b)], "j long, y array<double>, name string").repartition(3)
    got = candidates(left, right, k, "i", "j", 20, digits=9).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.i].append((r.d2, r.j, r.name))
    for i, x in enumerate(a):
        d = np.round(((b - x) ** 2).sum(1), 9)
        want = sorted((d[j], j, f"v{j}") for j in range(n))[:k]
        assert sorted(by[i])[:k] == [(pytest.approx(q), j, v) for q, j, v in want]
    assert candidates(left, right.limit(0), k, "i", "j").count() == candidates(left.limit(0), right, k, "i", "j", 20).count() == 0


def test_most_blocks_never_meet(spark):
    from airgrid.operators.match import candidates

    rng = np.random.default_rng(1)
    left = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.uniform(size=(40, 2)))], "i long, x array<double>").repartition(3)
    right = spark.createDataFrame([(j, y.tolist()) for j, y in enumerate(rng.uniform(size=(2000, 2)))], "j long, y array<double>").repartition(3)
    assert candidates(left, right, 3, "i", "j", 20).count() < 40 * 100 * 3 / 5


def test_level_pairs_of_many_scenes_are_counted_together(spark, monkeypatch):
    """Several angles in one pass equal those one by one, and no group of Python rows is a single tile's."""
    rng = np.random.default_rng(8)
    d = spark.createDataFrame([(k, r, c, float(rng.integers(0, 9))) for k in range(60) for r in range(7 + k % 2) for c in range(9)], "scene int, r int, c int, v double")
    pairs = {"a": (1, 45), "b": (2, 90)}
    got = t.cooccurrences(d, 4, 3, pairs, tile=5)
    assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().toString()
    both = sorted(map(tuple, got.collect()))
    assert both == sorted((name, *q) for name, (distance, angle) in pairs.items() for q in t.cooccurrence(d, 4, 3, distance, angle, 64).collect())
