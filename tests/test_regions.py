import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.operators import models as m
from airgrid.operators import regions as x

SCHEMA = "scene int, r int, c int, v double"


def grid(spark, rows):
    return spark.createDataFrame([(1, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], SCHEMA)


def test_connected_areas(spark):
    picture = ["#...#.", "#...#.", "#####.", "......", ".#..#.", "..#.#."]
    rows = [[1.0 if ch == "#" else 0.0 for ch in line] for line in picture]
    got = x.connected_areas(grid(spark, rows).filter("v > 0"), 0.8).select("label.r", "label.c", "cells", F.round("area", 6).alias("area")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 9, 7.2), (4, 1, 1, 0.8), (4, 4, 2, 1.6), (5, 2, 1, 0.8)]


def test_long_snake_is_one_area(spark):
    rows = [[1.0] * 7 if r % 2 == 0 else [1.0 if c == (6 if r % 4 == 1 else 0) else 0.0 for c in range(7)] for r in range(13)]
    got = x.connected_areas(grid(spark, rows).filter("v > 0")).collect()
    assert [g.cells for g in got] == [55]


def test_no_cells_no_areas(spark):
    assert x.connected_areas(spark.createDataFrame([], SCHEMA)).count() == 0


def test_perimeter_of_a_square(spark):
    cells = spark.createDataFrame([(1, r, c, 5) for r in range(3) for c in range(3)], "scene int, r int, c int, segment int")
    assert x.perimeter(cells).first()["perimeter"] == pytest.approx(8.0)


def test_resample_skips_nulls_and_keeps_constants(spark):
    got = x.resample(grid(spark, [[2.0, None], [2.0, 2.0]]), 0.5, 0.5, "bilinear").collect()
    assert len(got) == 16
    assert {g.v for g in got if g.v is not None} == {2.0}
    assert [(g.r, g.c) for g in got if g.v is None] == [(0, 3)]
    with pytest.raises(ValueError):
        x.resample(grid(spark, [[1.0]]), 1, 1, "spline")


def test_gap_fill(spark):
    got = {(g.r, g.c): g.v for g in x.idw_fill(grid(spark, [[1.0, None, 3.0]]), k=2).collect()}
    assert got[0, 1] == pytest.approx(2.0)
    lonely = x.idw_fill(grid(spark, [[None] * 3]), k=2).collect()
    assert [g.v for g in lonely] == [None] * 3


def test_relabel_turns_a_flipped_cell(spark):
    rows = [[(0.0 if c < 4 else 1.0) + 0.2 * ((r + c) % 3) for c in range(8)] for r in range(8)]
    rows[3][1] = 0.75  # nearer to the right half in value alone
    got = {(g.r, g.c): g.label for g in x.mrf_relabel(grid(spark, rows), 2, 6).collect()}
    assert got[3, 1] == 0 and got[3, 6] == 1


def test_nearest_neighbours_against_numpy(spark):
    rng = np.random.default_rng(3)
    a, y, b = rng.normal(size=(60, 3)), rng.normal(size=60), rng.normal(size=(9, 3))
    train = spark.createDataFrame([(i, a[i].tolist(), float(y[i])) for i in range(60)], "id long, x array<double>, y double")
    test = spark.createDataFrame([(i, b[i].tolist()) for i in range(9)], "id long, x array<double>")
    got = {g.id: g.prediction for g in m.knn_regress(train, test, 4).collect()}
    for i in range(9):
        assert got[i] == pytest.approx(y[np.argsort(((a - b[i]) ** 2).sum(1))[:4]].mean())


def test_dense_scores_of_null_features(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id long, q double")
    got = {g.id: g.score for g in m.mlp_score(df, [(np.array([[2.0]]), np.array([1.0]))], ["q"], "id").collect()}
    assert got == {1: 3.0, 2: None}


def test_wide_gaps_are_filled_from_the_nearest_cells(spark):
    rows = [[None if 1 <= r <= 13 and 2 <= c <= 14 or (r + c) % 5 == 0 else float(r * 17 + c * c) for c in range(16)] for r in range(15)]
    cells = spark.createDataFrame([(1, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)] + [(2, 0, c, 4.0 if c == 39 else None) for c in range(40)] + [(3, 0, 0, None)], SCHEMA)
    got = {(g.scene, g.r, g.c): g.v for g in x.idw_fill(cells).collect()}
    assert len(got) == 15 * 16 + 41 and got[3, 0, 0] is None
    assert all(got[2, 0, c] == pytest.approx(4.0) for c in range(40))
    valid = [(r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None]
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            near = sorted(((a - r) ** 2 + (b - c) ** 2, a, b, w) for a, b, w in valid)[:8]
            want = v if v is not None else sum(w / d for d, _, _, w in near) / sum(1 / d for d, _, _, _ in near)
            assert got[1, r, c] == pytest.approx(want)


def relabelled(v, rounds, n=2):
    span = v.max() - v.min()
    label = np.minimum(n - 1, np.floor((v - v.min()) * n / span)).astype(int) if span else np.zeros(v.shape, int)
    for _ in range(rounds):
        score = []
        for k in range(n):
            one, all_ = (np.pad(a, 1, mode="reflect") for a in ((label == k).astype(float), np.ones(v.shape)))
            near, cells = (sum(a[1 + i : 1 + i + v.shape[0], 1 + j : 1 + j + v.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j) for a in (one, all_))
            if not (label == k).any():
                score.append(np.full(v.shape, -1e300))
                continue
            dev = max(v[label == k].std(), 0.001)
            score.append(np.round(np.log(np.where(near > 0, near / cells, 0.001)) - np.log(dev) - ((v - v[label == k].mean()) / dev) ** 2 / 2, 9))
        label = np.argmax(score, 0)
    return label


def clustered(v, rounds, step=4, weight=0.0025):
    n = len(v)
    rc = np.array([(r, c) for r in range(n) for c in range(n)])
    seed = rc // step
    own, flat = [tuple(x) for x in seed], v.ravel()
    for _ in range(rounds):
        centre = {k: (rc[m].mean(0), flat[m].mean()) for k in set(own) for m in [[i for i, o in enumerate(own) if o == k]]}
        own = [min((round((flat[i] - value) ** 2 + weight * ((rc[i] - at) ** 2).sum(), 9), k) for k, (at, value) in centre.items() if abs(k[0] - seed[i][0]) <= 1 and abs(k[1] - seed[i][1]) <= 1)[1] for i in range(len(rc))]
    return own


def test_registered_relabelling_and_superpixels_run_all_rounds(spark, tmp_path):
    import __spark_entry__ as e

    rng = np.random.default_rng(1)
    scenes = [np.round(rng.normal(size=(8, 8)) + (np.arange(8) > 3) * k / 3, 3) for k in range(8)]
    spark.createDataFrame([(k, s.ravel().tolist()) for k, s in enumerate(scenes)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(g.scene, g.r, g.c): g.label for g in e.queries()["e8_contextual_relabel_whole"](spark, str(tmp_path)).collect()}
    want = [relabelled(s, 200) for s in scenes]
    assert any((relabelled(s, 3) != w).any() for s, w in zip(scenes, want))
    assert got == {(k, r, c): w[r, c] for k, w in enumerate(want) for r in range(8) for c in range(8)}
    got = {(g.scene, g.r, g.c): (g.sr, g.sc) for g in e.queries()["e9_superpixels_whole"](spark, str(tmp_path)).collect()}
    assert got == {(k, i // 8, i % 8): o for k, s in enumerate(scenes) for i, o in enumerate(clustered(s, 10))}


def test_registered_models_have_the_operators_sizes(spark, monkeypatch):
    import __spark_entry__ as e

    seen = []
    for name in ("forest_regressor", "forest_classifier", "boosted_trees", "bagged_trees"):
        monkeypatch.setattr(m, name, lambda *a, _n=name, **kw: seen.append((_n, kw)) or 1 / 0)
    for name in ("j2_out_of_fold", "j3_random_forest", "j4_boosted_trees", "j5_bagged_trees"):
        with pytest.raises(ZeroDivisionError):
            e.queries()[name](spark, "/root/testdata/sf0.001")
    assert seen == [(n, {}) for n in ("forest_regressor", "forest_classifier", "boosted_trees", "bagged_trees")]


def test_resampling_joins_no_taps(spark):
    rng = np.random.default_rng(2)
    cells = [(k, r, c, None if rng.random() < 0.3 else float(rng.normal())) for k in range(3) for r in range(11) for c in range(7 + k)]
    d = spark.createDataFrame(cells, SCHEMA)
    at = {(k, r, c): v for k, r, c, v in cells}

    def weights(x, method):
        low = int(np.floor(x))
        if method == "bilinear":
            return [(low + k, 1 - abs(x - low - k)) for k in (0, 1)]
        return [(a, 1.5 * e**3 - 2.5 * e**2 + 1 if e <= 1 else -0.5 * e**3 + 2.5 * e**2 - 4 * e + 2) for a in range(low - 1, low + 3) for e in [abs(x - a)]]

    for method in ("bilinear", "cubic"):
        for dy, dx in ((0.5, 0.4), (2.5, 1.0)):
            got = x.resample(d, dy, dx, method, tile=4)
            assert "Join" not in got._jdf.queryExecution().toString()
            got = {(q.scene, q.r, q.c): q.v for q in got.collect()}
            assert got == {(q.scene, q.r, q.c): q.v for q in x.resample(d, dy, dx, method).collect()} and len(got) == sum(round(11 / dy + 1e-9) * round((7 + k) / dx + 1e-9) for k in range(3))
            for (k, r, c), v in got.items():
                taps = [(wy * wx, at[k, y, z]) for y, wy in weights((r + 0.5) * dy - 0.5, method) for z, wx in weights((c + 0.5) * dx - 0.5, method) if at.get((k, y, z)) is not None]
                used = sum(w for w, _ in taps)
                assert v is None if abs(used) <= 1e-9 else v == pytest.approx(sum(w * a for w, a in taps) / used)


def test_small_scenes_go_through_all_rounds_in_one_batch(spark):
    """As large ones do by joins and windows, which small ones no longer need."""
    rng = np.random.default_rng(4)
    cells = [(k, r, c, None if k % 2 and rng.random() < 0.2 else round(float(rng.normal()) + (c > 3), 3)) for k in range(4) for r in range(6 if k else 1) for c in range(7 + k)]
    d = spark.createDataFrame(cells, SCHEMA)
    for job in (lambda small: x.mrf_relabel(d, 2, 5, small=small), lambda small: x.mrf_relabel(d, 3, 4, mirror=False, small=small), lambda small: x.superpixels(d, 3, 0.5, 3, small=small), lambda small: x.connected_areas(d.filter("v > 0.4"), 0.5, small=small)):
        few, both = job(1000), job(20)
        assert "Window" not in few._jdf.queryExecution().toString() and "Join" not in few._jdf.queryExecution().toString()
        assert few.schema.simpleString() == both.schema.simpleString()
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, both.collect()))
