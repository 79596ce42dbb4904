"""Small grids with values worked out by hand."""

from pyspark.sql import functions as F

from airgrid.functions import scalars as s
from airgrid.operators import grid as g
from airgrid.operators.match import fit_affine
from airgrid.sources.tables import pixels_to_tile


def grid(spark, rows):
    return spark.createDataFrame([("s", r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)], "scene string, r int, c int, v double")


def test_eddy(spark):
    got = {(x.r, x.c): x.eddy for x in g.eddy(grid(spark, [[1.0, 2.0, 1.0], [2.0, 10.0, None], [1.0, 2.0, 1.0]])).collect()}
    assert got[1, 1] == 10 - (2 + 2 + 2 + 10) / 4 and got[0, 0] == 0 and got[1, 2] == 0


def test_haar(spark):
    got = {(x.r, x.c): x.v for x in g.haar_approx(grid(spark, [[1.0, 2.0], [3.0, 4.0]]), 1).collect()}
    assert got == {(0, 0): 5.0}


def test_cooccurrence_mirrors_the_border(spark):
    got = g.cooccurrence(grid(spark, [[0.0, 0.0, 2.0]] * 3), 3, 3).groupBy("r", "c").agg(F.sum("n").alias("n")).collect()
    assert len(got) == 9 and all(x.n == 9 for x in got)


def test_affine_and_round_trip(spark):
    p = spark.createDataFrame([("s", float(r), float(c), 2.0 * c - 3.0 * r + 7) for r in (0, 4) for c in (0, 5)], "scene string, r double, c double, x double")
    x = fit_affine(p, "x").first()
    assert [round(v, 9) for v in (x.a, x.b, x.o)] == [2, -3, 7]
    t = (79.0, 0.5, 0.0, 31.0, 0.0, -0.5)
    d = spark.range(5).select(F.col("id").alias("r"), (F.col("id") + 1).alias("c"))
    lon, lat = s.pixel_to_geo(t, F.col("r"), F.col("c"))
    row, col = s.geo_to_pixel(t, lon, lat)
    assert all(x.r == x.a and x.c == x.b for x in d.select("r", "c", row.alias("a"), col.alias("b")).collect())


def test_tile_keeps_gaps(spark):
    p = spark.createDataFrame([("s", 0, 0, 1.0), ("s", 1, 1, 4.0)], "scene string, r int, c int, v double")
    assert pixels_to_tile(p).first().data == [[1.0, None], [None, 4.0]]


def test_completeness_gate_and_empty(spark):
    rows = [("a", f"2024-01-01 {h:02d}:00:00", 1.0) for h in range(21)] + [("a", f"2024-01-02 {h:02d}:00:00", 1.0) for h in range(20)]
    d = spark.createDataFrame(rows, "station string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert [x.n for x in g.daily_station_mean(d).collect()] == [21]
    assert g.daily_station_mean(d.limit(0)).count() == 0


def test_clip_is_even_odd(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 2.5, 0.2)], "id int, lon double, lat double")
    z = spark.createDataFrame([("z", [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)])], "zone string, ring array<struct<x:double,y:double>>")
    assert [x.id for x in g.clip(p, z).collect()] == [1]


def test_streaming_twin(spark, tmp_path):
    from airgrid.streaming.jobs import daily_means

    rows = [("a", f"2024-01-0{d} {h:02d}:00:00", float(h)) for d in (1, 2, 9) for h in range(4)]
    d = spark.createDataFrame(rows, "station string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "in"))
    q = daily_means(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), 3).writeStream.format("memory").queryName("twin").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x.station, str(x.date)): x.value for x in spark.table("twin").collect()}
    want = {(x.station, str(x.date)): x.value for x in g.daily_station_mean(d, 3).collect()}
    assert got.items() <= want.items() and len(got) >= 2


def test_nearest_stations_in_blocks(spark):
    import math
    import random

    rng = random.Random(5)
    places = [(79 + (k % 13) * 0.9, 25 + (k % 7) * 0.85) for k in range(150)] + [(None, 30.0)]
    stations = [(k, *p, rng.random()) for k, p in enumerate(places)]
    points = [(k, 79 + rng.random() * 12, 25 + rng.random() * 6) for k in range(39)] + [(39, *places[3]), (40, None, 1.0)]

    def far(a, b):
        a, b = [tuple(map(math.radians, x)) for x in (a, b)]
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((b[1] - a[1]) / 2) ** 2 + math.cos(a[1]) * math.cos(b[1]) * math.sin((b[0] - a[0]) / 2) ** 2))

    s = spark.createDataFrame(stations, "station long, lon double, lat double, value double")
    p = spark.createDataFrame(points, "id long, lon double, lat double")
    got = {x.id: (x.ps, x.ps_dist) for x in g.knn_idw(p, s, 4, 16).collect()}
    assert len(got) == 41 and got[40] == (None, None) and got[39] == (stations[3][3], 0)
    for i, *at in points[:39]:
        near = sorted((far(at, x[1:3]), x[0], x[3]) for x in stations if x[1] is not None)[:4]
        mean = sum(v / d**2 for d, _, v in near) / sum(1 / d**2 for d, _, _ in near)
        assert abs(got[i][0] - mean) < 1e-9 and abs(got[i][1] - near[0][0]) < 1e-9
    many = spark.range(20_001).select(F.col("id").alias("station"), (F.col("id") % 360 - 180).cast("double").alias("lon"), F.lit(0.0).alias("lat"), F.col("id").cast("double").alias("value"))
    assert g.knn_idw(p.filter("id = 0"), many).count() == 1
