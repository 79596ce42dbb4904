"""Points, alignment, gaps, hulls, readers, writers, streams and models on small inputs worked out by hand."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.functions import scalars as s
from airgrid.operators import grid as g
from airgrid.operators import models as m
from airgrid.operators import prediction as p
from airgrid.operators.match import nearest_rows, ratio_match
from airgrid.sources import tables as t
from airgrid.streaming import jobs


def test_points_and_bounds(spark):
    scenes = spark.createDataFrame([(1, 80.0, 1.0, 0.0, 30.0, 0.0, -1.0, 2, 3), (2, 100.0, 1.0, 0.0, 30.0, 0.0, -1.0, 2, 3)], "scene int, t0 double, t1 double, t2 double, t3 double, t4 double, t5 double, n_rows int, n_cols int")
    pixels = spark.createDataFrame([(k, r, c, 10.0 * r + c) for k in (1, 2) for r in range(2) for c in range(3)], "scene int, r int, c int, b1 double")
    stations = spark.createDataFrame([("in", 82.5, 28.5), ("left", 79.9, 29.5), ("edge", 83.0, 29.0), ("below", 81.0, 27.99), ("corner", 80.0, 30.0), ("lost", None, 29.0)], "station string, lon double, lat double")
    got = {(x.station, x.scene): (x.r, x.c, x.b1) for x in p.extract_at_points(pixels, scenes, stations).collect()}
    assert got == {("in", 1): (1, 2, 12.0), ("corner", 1): (0, 0, 0.0)}
    assert p.extract_at_points(pixels, scenes, stations.limit(0)).count() == 0


def test_layers_on_other_grids(spark):
    day = dt.date(2020, 1, 1)
    target = spark.createDataFrame([(day, r, c) for r in range(4) for c in range(4)], "date date, r int, c int")
    coarse = spark.createDataFrame([(day, r, c, 10.0 * r + c) for r in range(2) for c in range(2)], "date date, r int, c int, v double")
    static = spark.createDataFrame([(0, 0, 7.0)], "r int, c int, v double")
    layers = {"a": p.Layer(coarse, (1.0, 2.0, 0.0, 4.0, 0.0, -2.0)), "b": p.Layer(coarse.withColumn("v", -F.col("v")), (1.0, 2.0, 0.0, 4.0, 0.0, -2.0)), "h": p.Layer(static, (0.0, 1.0, 0.0, 4.0, 0.0, -1.0), ())}
    got = {(x.r, x.c): (x.a, x.b, x.h) for x in p.align_layers(target, (0.0, 1.0, 0.0, 4.0, 0.0, -1.0), layers).collect()}
    assert len(got) == 16
    for (r, c), (a, b, h) in got.items():
        want = None if c == 0 else 10.0 * (r // 2) + (c - 1) // 2
        assert a == want and b == (None if want is None else -want) and h == (7.0 if (r, c) == (0, 0) else None)


def test_predictions_keep_their_gaps(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 0.0, float("nan"))], "id int, x double, y double")
    got = {x.id: x.prediction for x in p.predict_present(d, ["x", "y"], lambda q: q.withColumn("prediction", F.col("x") + F.col("y"))).collect()}
    assert got == {1: 3.0, 2: None, 3: None}
    masked = d.select("id", p.mask_result(F.lit(5.0), F.col("x")).alias("v")).collect()
    assert [x.v for x in sorted(masked)] == [5.0, 5.0, 0.0]


def test_stack_merge_samples_accuracy(spark):
    day = dt.date(2020, 3, 2)
    a = spark.createDataFrame([(day, r, c, 1.0) for r in range(3) for c in range(2)], "date date, r int, c int, v double")
    b = spark.createDataFrame([(day, r, c, 2.0) for r in range(2) for c in range(3)], "date date, r int, c int, v double")
    month = spark.createDataFrame([(dt.date(2020, 3, 31), 0, 0, 9.0), (dt.date(2020, 4, 1), 1, 1, 8.0)], "date date, r int, c int, v double")
    assert p.stack_layers({"a": a, "b": b}).count() == 4
    assert [(x.r, x.c, x.n) for x in p.stack_layers({"a": a, "b": b, "n": month}, ("n",)).collect()] == [(0, 0, 9.0)]
    assert p.merge_datasets({"a": a, "b": b}).filter("a is null or b is null").count() == 4
    u = p.class_samples({0: spark.createDataFrame([(1.0, 0)], "x double, prediction int"), 1: spark.createDataFrame([(0,), (1,), (None,)], "prediction int")})
    assert p.accuracy(u).first().asDict() == {"n": 4, "accuracy": 0.5}


def test_convex_area_of_shapes(spark):
    shapes = {1: [(0, 0)], 2: [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)], 3: [(0, 2), (1, 0), (1, 4), (3, 1), (4, 4)]}
    d = spark.createDataFrame([(0, k, r, c) for k, x in shapes.items() for r, c in x], "scene int, segment int, r int, c int")
    got = {x.segment: x.convex_area for x in p.convex_area(d).collect()}
    for k, cells in shapes.items():
        pts = np.array(sorted({(r + i, c + j) for r, c in cells for i in (0, 1) for j in (0, 1)}))
        ring = []  # a side has all points on one hand
        for a, b in itertools.permutations(pts, 2):
            side = (b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0])
            if (side >= 0).all():
                between = pts[(side == 0)]
                if np.abs(between - a).sum(1).max() <= np.abs(b - a).sum() and all((q - a) @ (b - a) >= 0 for q in between):
                    ring.append(a[0] * b[1] - a[1] * b[0])
        assert got[k] == pytest.approx(abs(sum(ring)) / 2)
    assert got[1] == 1.0 and got[2] == 7.0


def test_calendar_and_angles(spark):
    d = spark.range(1).select(s.everyday(F.lit(2020), F.lit("20200227"), F.lit("20200301")).alias("days"), s.year_code(F.lit("2020-05-01").cast("date")).alias("y"), s.wrap_longitude(F.lit(-190.0), -180.0).alias("lon"), s.hour_angle(F.lit(46800), F.lit(600), F.lit("-")).alias("h"), s.hour_angle(F.lit(0), F.lit(0), F.lit("?")).alias("none")).first()
    assert d.days == ["20200227", "20200228", "20200229", "20200301"] and d.lon == 170.0 and d.h == pytest.approx(12.5) and d.none is None
    assert d.y == pytest.approx((2020 - 2018) / np.std([2016, 2017, 2018, 2019, 2020]))
    with pytest.raises(Exception, match="outside the year"):
        spark.range(1).select(s.everyday(F.lit(2020), F.lit("20201230"), F.lit("20210102"))).collect()


def test_wind_window_includes_both_ends(spark):
    rows = [("u", "2020-01-01 02:45:00", 3.0), ("v", "2020-01-01 02:45:00", 4.0), ("u", "2020-01-01 06:45:01", 100.0), ("v", "2020-01-01 06:45:01", 100.0), ("u", "2020-01-01 06:45:00", 0.0), ("v", "2020-01-01 06:45:00", 1.0), ("u", "2020-01-01 04:00:00", 9.0)]
    d = spark.createDataFrame(rows, "variable string, ts string, value double").select("variable", F.to_timestamp("ts").alias("ts"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), "value")
    got = p.morning_wind(p.pair_components(d, "u", "v"), "Asia/Kathmandu").collect()
    assert len(got) == 1 and got[0].speed == pytest.approx(3.0) and got[0].direction == pytest.approx((180 + 53.13010235 + 270) / 2)


def test_blocks_of_vectors(spark):
    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(size=(40, 3)), 1), np.round(rng.normal(size=(90, 3)), 1)
    at, who, d2 = nearest_rows(x, y, 3)
    for i in range(40):
        want = np.argsort(((y - x[i]) ** 2).sum(1), kind="stable")[:3]
        assert who[at == i].tolist() == want.tolist()
    a, b = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "id long, x array<double>") for z in (x, y))
    got = {r.i: r.j for r in ratio_match(a, b, 0.75, 16).collect()}
    for i in range(40):
        d = np.sqrt(((y - x[i]) ** 2).sum(1))
        j, k = np.argsort(d, kind="stable")[:2]
        assert (got.get(i) == j) == (d[j] < 0.75 * d[k])
    assert ratio_match(a, b.limit(0)).count() == 0


def test_texture_counts_by_hand(spark):
    cells = spark.createDataFrame([("s", r, c, float(r * c % 3)) for r in range(5) for c in range(5)], "scene string, r int, c int, v double")
    got = {(x.r, x.c, x.i, x.j): x.n for x in g.cooccurrence(cells, 3, 3).collect()}
    v = np.array([[r * c % 3 for c in range(5)] for r in range(5)])
    i, j = v, np.c_[v[:, 1:], v[:, -1:]]
    pi, pj = (np.pad(z, 1, mode="reflect") for z in (i, j))
    want = {}
    for r in range(5):
        for c in range(5):
            for a, b in zip(pi[r : r + 3, c : c + 3].ravel().tolist(), pj[r : r + 3, c : c + 3].ravel().tolist()):
                want[r, c, a, b] = want.get((r, c, a, b), 0) + 1
    assert got == want


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "st.csv").write_bytes("﻿station,value\n北,1.5\n".encode("utf-8"))
    (tmp_path / "gbk.csv").write_bytes("station,value\n北,2.5\n".encode("gbk"))
    schema = "station string, value double"
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert [tuple(r) for f, enc in (("st", "UTF-8"), ("gbk", "GBK")) for r in t.read_station_csv(spark, f"{tmp_path}/{f}.csv", kind, enc).collect()] == [("北", 1.5), ("北", 2.5)]
    (tmp_path / "ph").mkdir()
    (tmp_path / "ph" / "200304_x.csv").write_text("a\nb\nc\nd\nDate,Time,A,B,C\n04:03:2020,10:00:00,0.5,0.25,1.1\n04:03:2020,11:00:00,0.6,,\n")
    rows = t.read_photometer(spark, f"{tmp_path}/ph", "site").collect()
    assert [(r.site, r.date, r.time, r.aot_440, r.aot_675) for r in rows] == [("site", dt.date(2020, 3, 4), "10:00:00", 0.5, 0.25), ("site", dt.date(2020, 3, 4), "11:00:00", 0.6, None)]
    (tmp_path / "pt.txt").write_text("lat lon\n27.5 85.25\n")
    assert tuple(t.read_points_txt(spark, f"{tmp_path}/pt.txt").first()) == (27.5, 85.25)
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.json").write_text('{"station": "x", "value": 1}\n{"station": "y"}\n')
    assert sorted((r.station, r.value) for r in t.read_feed_json(spark, f"{tmp_path}/feed", schema).collect()) == [("x", 1.0), ("y", None)]
    cube = spark.sql("select 't2m' variable, array(0, 30) hours, timestamp'1900-01-01' epoch, array(1D, 2D) lats, array(5D) lons, array(array(array(1D), array(2D)), array(array(3D), array(null))) values")
    got = {(str(r.ts), r.lat, r.lon): r.value for r in t.explode_cube(cube).collect()}
    assert got == {("1900-01-01 00:00:00", 1.0, 5.0): 1.0, ("1900-01-01 00:00:00", 2.0, 5.0): 2.0, ("1900-01-02 06:00:00", 1.0, 5.0): 3.0, ("1900-01-02 06:00:00", 2.0, 5.0): None}
    long = spark.createDataFrame([(1, 0, 0, "b1", 1.0), (1, 0, 0, "b2", 2.0), (1, 0, 1, "b2", 3.0)], "scene int, r int, c int, band string, v double")
    assert sorted(map(tuple, t.stack_bands(long, ["b1", "b2"]).collect())) == [(1, 0, 0, 1.0, 2.0), (1, 0, 1, None, 3.0)]
    cells = spark.createDataFrame([("aod", dt.date(2020, 1, k), 0, k, v) for k, v in ((1, -4.0), (2, 300.0), (3, 7.9))], "variable string, date date, row int, col int, value double")
    t.write_layers(cells, f"{tmp_path}/layers", "byte")
    back = spark.read.parquet(f"{tmp_path}/layers")
    assert {str(r.date): r.value for r in back.collect()} == {"2020-01-01": 0, "2020-01-02": 255, "2020-01-03": 7}
    t.write_table(cells, f"{tmp_path}/csv", "csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 3
    (tmp_path / "files").mkdir()
    for name in ("GF1_20200102_aod.tif", "GF2_20200102_aod.tif", "20200103_ndvi.tif"):
        (tmp_path / "files" / name).write_text("x")
    files = t.catalogue(spark, f"{tmp_path}/files")
    assert {(r.sensor, str(r.date), r.variable) for r in files.collect()} == {("GF1", "2020-01-02", "aod"), ("GF2", "2020-01-02", "aod"), ("", "2020-01-03", "ndvi")}
    days = spark.createDataFrame([(dt.date(2020, 1, k),) for k in (2, 4)], "date date")
    assert {(str(r.date), r.name) for r in t.first_of_day(files, days).collect()} == {("2020-01-02", "GF1_20200102_aod.tif"), ("2020-01-04", None)}


def streamed(spark, df, folder, job):
    df.write.mode("append").parquet(f"{folder}/in")
    out = job(spark.readStream.schema(df.schema).parquet(f"{folder}/in"))
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def hourly(spark, rows):
    return spark.createDataFrame(rows, "station string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))


def test_streams_against_their_batch_twins(spark, tmp_path):
    d = hourly(spark, [("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-01 10:00:00", 1.0), ("b", "2024-01-01 10:00:00", 2.0)])
    assert len(streamed(spark, d, f"{tmp_path}/dedup", jobs.deduplicate)) == 2
    places = spark.createDataFrame([("a", 80.0)], "station string, lon double")
    assert [(x.station, x.lon) for x in streamed(spark, d, f"{tmp_path}/rich", lambda x: jobs.enrich(x, places))] == [("a", 80.0)] * 2
    passes = spark.createDataFrame([(1, "a", "2024-01-01 12:00:00"), (2, "a", "2024-01-01 11:59:00"), (3, "b", "2024-01-01 08:30:00")], "pass_id int, site string, pass_ts string").withColumn("pass_ts", F.to_timestamp("pass_ts"))
    passes.write.parquet(f"{tmp_path}/passes")
    got = streamed(spark, d.dropDuplicates(), f"{tmp_path}/match", lambda x: jobs.match_passes(spark.readStream.schema(passes.schema).parquet(f"{tmp_path}/passes"), x))
    assert {(x.pass_id, x.value) for x in got} == {(2, 1.0), (3, 2.0)}  # strictly inside two hours


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    first = [("a", f"2024-01-0{k} 0{h}:00:00", 1.0) for k in (1, 5) for h in range(3)]
    streamed(spark, hourly(spark, first).coalesce(1), tmp_path, lambda x: jobs.daily_means(x, 2))
    late = [("a", "2024-01-01 09:00:00", 100.0)] + [("a", f"2024-01-09 0{h}:00:00", 1.0) for h in range(3)]
    got = {str(x.date): (x.n, x.value) for x in streamed(spark, hourly(spark, late).coalesce(1), tmp_path, lambda x: jobs.daily_means(x, 2))}
    assert got["2024-01-01"] == (3, 1.0) and got["2024-01-05"] == (3, 1.0)


def test_models_beat_the_mean_on_rows_they_did_not_see(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (600, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] ** 2 + 0.1 * rng.normal(size=600)
    d = spark.createDataFrame([(i, *map(float, v), float(w), float(w > 0), i % 3) for i, (v, w) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double, label double, fold int").cache()
    names, train, test = ["a", "b", "c"], d.filter("fold <> 0"), d.filter("fold = 0")

    def r2(got):
        return g.regression_metrics(got.withColumn("fold", F.lit(0)), "y", "prediction").filter("fold is null").first().r2

    assert r2(m.out_of_fold(d, m.forest_regressor(names, "y", 20, 6), 3)) > 0.8
    for learner in (m.boosted_trees(names, "y", 15, 3), m.bagged_trees(names, "y", 15, 6)):
        assert r2(learner.fit(train).transform(test)) > 0.8
    assert p.accuracy(m.forest_classifier(names, "label", 20, 6).fit(train).transform(test)).first().accuracy > 0.85
    assert r2(m.search_boosted(train, names, "y", {"maxDepth": [1, 3], "maxIter": [5]}, 2).transform(test)) > 0.6


def test_nearest_rows_measure_few_pairs_and_heed_a_bound():
    rng = np.random.default_rng(6)
    x, y = 1000 + np.round(rng.normal(size=(50, 2)), 1), 1000 + np.round(rng.normal(size=(400, 2)), 1)
    far = ((x[:, None] - y) ** 2).sum(2).round(9)
    at, who, d2 = nearest_rows(x, y, 5, 9)
    assert who.tolist() == np.argsort(far, axis=1, kind="stable")[:, :5].ravel().tolist() and (d2 == far[at, who]).all()
    bound = np.where(np.arange(50) % 2, 0.05, np.nan)
    at, who, _ = nearest_rows(x, y, 5, 9, bound=bound)
    for i in range(50):
        want = [j for j in np.argsort(far[i], kind="stable")[:5] if not i % 2 or far[i, j] <= 0.05]
        assert [j for j in who[at == i].tolist() if not i % 2 or far[i, j] <= 0.05] == want


def test_a_search_trains_only_the_longest_boosting(spark, monkeypatch):
    rng = np.random.default_rng(5)
    d = spark.createDataFrame([(float(a), float(b), float(a * 3 + b)) for a, b in rng.normal(size=(150, 2))], "a double, b double, y double")
    seen, make = [], m.boosted_trees

    def counted(*a, **kw):
        learner = make(*a, **kw)
        fit = type(learner).fit
        monkeypatch.setattr(type(learner), "fit", lambda self, data, params=None: seen.append({p.name: v for p, v in (params or {}).items()}) or fit(self, data, params))
        return learner

    monkeypatch.setattr(m, "boosted_trees", counted)
    best = m.search_boosted(d, ["a", "b"], "y", {"maxDepth": [2], "maxIter": [2, 4]}, 2)
    assert [s["maxIter"] for s in seen if s][:2] == [4, 4] and len([s for s in seen if s]) == 3
    assert len(best.avgMetrics) == 2 and best.avgMetrics[1] > best.avgMetrics[0]
