"""Whole jobs against brute force on small tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from airgrid.operators import grid as g
from airgrid.operators import jobs as j
from airgrid.operators import prediction as p
from airgrid.operators import regions as x

SCENE = "scene int, t0 double, t1 double, t3 double, t5 double, n_rows int, n_cols int"


def areas_by_hand(cells):
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            r, c = todo.pop()
            part.append((r, c))
            for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append((min(part), len(part)))
    return sorted(out)


def test_change_areas_on_the_intersection(spark):
    rng = random.Random(5)
    grids = {s: [[rng.randrange(3) for _ in range(7)] for _ in range(6)] for s in range(6)}
    origin = {0: (0.0, 10.0), 1: (2.0, 9.0), 2: (0.0, 10.0), 3: (-3.0, 12.0), 4: (0.0, 10.0), 5: (50.0, 10.0)}
    classes = spark.createDataFrame([(s, r, c, k, "x") for s, grid in grids.items() for r, row in enumerate(grid) for c, k in enumerate(row)], "scene int, r int, c int, class int, pair string").drop("pair")
    scenes = spark.createDataFrame([(s, t0, 1.0, t3, -1.0, 6, 7) for s, (t0, t3) in origin.items()], SCENE)
    pairs = spark.createDataFrame([(s, s, s + 1) for s in (0, 2, 4)], "pair int, a int, b int")
    got = sorted((v.pair, (v.r, v.c), v.cells, v.area) for v in j.change_areas(classes, pairs, scenes, -1, 0.5).collect())
    want = []
    for a in (0, 2, 4):
        dr, dc = round((origin[a + 1][1] - origin[a][1]) / -1), round(origin[a + 1][0] - origin[a][0])
        both = {(r, c) for r in range(6) for c in range(7) if 0 <= r - dr < 6 and 0 <= c - dc < 7}
        r0, c0 = max(0, dr), max(0, dc)
        cells = [(r - r0, c - c0) for r, c in both if grids[a][r][c] - grids[a + 1][r - dr][c - dc] == -1]
        want += [(a, first, n, n * 0.5) for first, n in areas_by_hand(cells)]
    assert got == sorted(want) and {v[0] for v in got} == {0, 2}  # scenes 4 and 5 don't meet
    assert j.change_areas(classes.limit(0), pairs, scenes, -1).count() == 0


def test_segment_classes_paint_means_and_holes(spark):
    rng = random.Random(3)
    rows = [("a", r, c, None if rng.random() < 0.2 else rng.random(), "extra") for r in range(8) for c in range(8)]
    pixels = spark.createDataFrame(rows, "scene string, r int, c int, v double, class string")
    got = {(v.r, v.c): v["class"] for v in j.segment_classes(pixels, lambda v: (v > 0.5).cast("int") + 1, 4, 0.2, 2).collect()}
    groups = {}
    for v in x.superpixels(pixels, 4, 0.2, 2).collect():
        groups.setdefault((v.sr, v.sc), []).append(v)
    want = {(r, c): 0 for _, r, c, v, _ in rows if v is None}
    for members in groups.values():
        mean = sum(v.v for v in members) / len(members)
        want |= {(v.r, v.c): 2 if mean > 0.5 else 1 for v in members}
    assert got == want and len(got) == 64
    assert j.segment_classes(pixels.limit(0), lambda v: (v > 0.5).cast("int"), 4).count() == 0


def test_daily_map(spark):
    hour = dt.datetime(2024, 3, 1, 4, 0)  # 09:45 in Kathmandu
    fine, coarse = (0.0, 1.0, 0.0, 4.0, 0.0, -1.0), (0.0, 2.0, 0.0, 4.0, 0.0, -2.0)
    values = [(hour, 0.5, 3.5, 8.0, "k"), (hour, 0.5, 3.5, 12.0, "k"), (hour, 0.7, 3.6, 6.0, "k"), (hour, 1.5, 3.5, 1.0, "k"), (hour, 2.5, 1.5, 9.0, "k"), (hour, 0.5, 2.5, None, "k"), (dt.datetime(2024, 3, 1, 20, 0), 0.5, 3.5, 5.0, "k")]
    winds = [(hour, 3.0, 1.0, 3.0, 4.0), (hour + dt.timedelta(hours=9), 1.0, 3.0, 30.0, 40.0), (dt.datetime(2024, 3, 2, 4, 0), 3.0, 1.0, 6.0, 8.0)]
    vs = spark.createDataFrame(values, "ts timestamp_ntz, lon double, lat double, value double, r string")
    ws = spark.createDataFrame(winds, "ts timestamp_ntz, lat double, lon double, u double, v double")
    dem = spark.createDataFrame([(0, 0, 2.0), (0, 1, 4.0), (1, 0, 4.0)], "r int, c int, v double")

    def score(df):
        return df.withColumn("prediction", F.col("speed") * 100 + F.col("dem"))

    def run(of):
        return {(str(v.date), v.r, v.c): (v.value, v.prediction) for v in j.daily_map(of, ws, fine, coarse, {"dem": p.Layer(dem, fine, ())}, score, "Asia/Kathmandu", 2.0).collect()}

    first, second = "2024-03-01", "2024-03-02"
    assert run(vs) == {
        (first, 0, 0): (6.0, 50.5),  # mean 8 of two places' means 10 and 6
        (first, 0, 1): (0.0, 0.0),  # never below 0, then masked
        (first, 2, 2): (7.0, None),  # no wind and no height there
        (first, 1, 0): (None, 51.0),
        (second, 0, 0): (3.0, 100.5),  # 20:00 UTC is the next day there
    }
    assert run(vs.limit(0)) == {}


def test_training_table(spark):
    rng = random.Random(9)
    stations = [(s, 0.5 + rng.randrange(4) + rng.random() / 3, 3.5 - rng.randrange(4) + rng.random() / 3) for s in range(12)] + [(12, 40.0, 40.0), (13, None, 1.0)]
    readings, n = [], 0
    for s, _, _ in stations:
        for day in (1, 2):
            for hour in range(rng.randrange(1, 5)):
                for _ in range(rng.randrange(1, 3)):
                    n += 1
                    readings.append((s, dt.datetime(2024, 1, day, hour), rng.choice([None, -1.0, 2.0, 5.0, 7.5]), n))
    pixels = [(k, r, c, None if (r + c) % 5 == 0 else float(r * 10 + c + k)) for k in (1, 2) for r in range(4) for c in range(4) if (r, c) != (3, 3)]
    rd = spark.createDataFrame(readings, "station long, ts timestamp_ntz, value double, event_id long").withColumn("fold", F.lit("clash")).withColumn("scene", F.lit("clash"))
    st = spark.createDataFrame(stations, "station long, lon double, lat double")
    px = spark.createDataFrame(pixels, "scene int, r int, c int, b1 double").withColumn("y", F.lit("clash"))
    sc = spark.createDataFrame([(k, 0.0, 1.0, 0.0, 4.0, 0.0, -1.0, 4, 4) for k in (1, 2)], "scene int, t0 double, t1 double, t2 double, t3 double, t4 double, t5 double, n_rows int, n_cols int")
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)], "date date, scene int")
    got = {(v.station, v.date.day, v.scene): (v.fold, v.y, v.b1, v.ps, v.ps_dist) for v in j.training_table(rd, st, px, sc, days, ["b1"], 2, 3, 5).collect()}

    seen = {}
    for s, ts, v, _ in readings:
        if v is not None and v > 0:
            seen.setdefault((s, ts), v)
    by_day, by_station = {}, {}
    for (s, ts), v in seen.items():
        by_day.setdefault((s, ts.day), []).append(v)
        by_station.setdefault(s, []).append(v)
    held = {(k, r, c): v for k, r, c, v in pixels}

    def km(a, b):
        la, lb = math.radians(a[1]), math.radians(b[1])
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2))

    rows = {}
    for (s, day), v in by_day.items():
        _, lon, lat = stations[s]
        if len(v) < 2 or lon is None or not (0 <= 4 - lat < 4 and 0 <= lon < 4):
            continue
        r, c = math.floor(4 - lat), math.floor(lon)
        if (day, r, c) in held:
            near = sorted((km((c + 0.5, 4 - r - 0.5), (x_, y_)), o) for o, x_, y_ in stations if o != s and o in by_station and x_ is not None)[:3]
            mean = {o: sum(by_station[o]) / len(by_station[o]) for _, o in near}
            rows[s, day, day] = [s * 48271 % 2147483647 % 5, sum(v) / len(v), held[day, r, c], sum(mean[o] / d**2 for d, o in near) / sum(1 / d**2 for d, _ in near), near[0][0]]
    for k in (2, 3, 4):
        fit = [v[k] for v in rows.values() if v[0] != 0 and v[k] is not None]
        for v in rows.values():
            v[k] = None if v[k] is None else (v[k] - min(fit)) / (max(fit) - min(fit))
    assert set(got) == set(rows) and len(rows) > 6
    for key, want in rows.items():
        assert got[key][0] == want[0] and got[key][1:] == pytest.approx(want[1:], abs=1e-9)
    alone = j.training_table(rd.filter("station = 0"), st, px, sc, days, ["b1"], 1, 3, 5).collect()
    assert all(v.ps is None and v.ps_dist is None for v in alone)
    assert j.training_table(rd.limit(0), st, px, sc, days, ["b1"]).count() == 0


def test_nearest_others(spark):
    s = spark.createDataFrame([(k, float(k), 0.0, float(k * k)) for k in range(5)], "station long, lon double, lat double, value double")
    points = s.select(F.col("station").alias("id"), "lon", "lat")
    got = {v.id: v.ps for v in g.knn_idw(points, s, 1, own=F.col("id")).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 1.0, 3: 4.0, 4: 9.0}
    assert g.knn_idw(points.limit(1), s.limit(1), 1, own=F.col("id")).count() == 0


def test_stations_of_one_place_are_met_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(g, "candidates", lambda a, b, *x, _do=g.candidates, **kw: seen.append((a.count(), b.count())) or _do(a, b, *x, **kw))
    rows = [(k, 80.0 + k % 5, 25.0 + k % 3, float(k)) for k in range(90)]
    s = spark.createDataFrame(rows, "station long, lon double, lat double, value double")
    points = s.select(F.col("station").alias("id"), (F.col("lon") + 0.1).alias("lon"), "lat")
    for own in (None, F.col("id")):
        got = {v.id: v.ps for v in g.knn_idw(points, s, 8, own=own).collect()}
        assert len(got) == 90 and seen.pop() == (15, 15)
        near = s.withColumnRenamed("lon", "slon").withColumnRenamed("lat", "slat").crossJoin(points).withColumn("d", g.haversine(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))).collect()
        for k in range(0, 90, 7):
            best = sorted((q.d, q.station, q.value) for q in near if q.id == k and (own is None or q.station != k))[:8]
            assert got[k] == pytest.approx(sum(v / d**2 for d, _, v in best) / sum(1 / d**2 for d, _, _ in best))
