"""Registered queries of whole jobs, with their DuckDB twins."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import scalars as s
from ..operators import jobs as j
from ..operators import models as m
from ..operators import prediction as p
from .prediction import _SCENES, _STATIC, _UV, _scenes, _uv
from .queries import _CTE, query, r6
from .regions import _superpixel_sql

# station truth and pixels to a table for training
@query(
    "w1_training_table",
    f"""{_SCENES}, fr as (select station, ts, value from readings where value > 0 qualify row_number() over (partition by station, ts order by event_id) = 1),
dm as (select station, ts::date date, count(*) n, avg(value) y from fr group by 1, 2 having count(*) >= 2),
al as (select station, avg(value) v from fr group by 1),
ex as (select station, scene, p.r, p.c, b1, (b4 - b3) / nullif(b4 + b3, 0) ndvi, t0 + (p.c + 0.5::double) * t1 lon, t3 + (p.r + 0.5::double) * t5 lat from stations join sc on (lat - t3) / t5 >= 0 and (lat - t3) / t5 < n_rows and (lon - t0) / t1 >= 0 and (lon - t0) / t1 < n_cols join pixels p using (scene) where p.r = floor((lat - t3) / t5) and p.c = floor((lon - t0) / t1)),
nb as (select x.station, x.scene, s.station o, v, 2 * 6371.0088::double * asin(least(1, sqrt(sin(radians(s.lat - x.lat) / 2) ** 2 + cos(radians(x.lat)) * cos(radians(s.lat)) * sin(radians(s.lon - x.lon) / 2) ** 2))) km from ex x, stations s join al on al.station = s.station where s.station <> x.station),
nk as (select station, scene, sum(v / km ** 2) / sum(1 / km ** 2) ps, min(km) ps_dist from (select *, row_number() over (partition by station, scene order by km, o) k from nb) where k <= 4 group by 1, 2),
tb as (select d.station, d.date, e.scene, ((d.station * 48271) % 2147483647) % 5 fold, d.y, b1, coalesce(ndvi, 0) ndvi, ps, ps_dist from dm d join ex e on e.station = d.station and e.scene = 1992 + dayofyear(d.date) % 7 left join nk k on k.station = e.station and k.scene = e.scene),
lm as (select {', '.join(f'min({c}) {c}_lo, max({c}) {c}_hi' for c in ('b1', 'ndvi', 'ps', 'ps_dist'))} from tb where fold <> 0)
select station, date, scene, fold::int fold, round(y, 6) y, {', '.join(f'round(({c} - {c}_lo) / ({c}_hi - {c}_lo), 6) {c}' for c in ('b1', 'ndvi', 'ps', 'ps_dist'))} from tb, lm""",
)
def _(spark, d):
    """Days meet one of seven scenes."""
    x = b.readings(spark, d)
    days = x.select(F.to_date("ts").alias("date")).distinct().withColumn("scene", 1992 + F.dayofyear("date") % 7)
    bands = b.pixels(spark, d).select("scene", "r", "c", "b1", s.ndvi(F.col("b4"), F.col("b3")).alias("ndvi"))
    got = j.training_table(x, b.stations(spark, d), bands, _scenes(spark, d), days, ["b1", "ndvi"], min_rows=2, m=4, folds=5)
    return got.select("station", "date", "scene", F.col("fold").cast("int").alias("fold"), r6("y").alias("y"), *[r6(c).alias(c) for c in ("b1", "ndvi", "ps", "ps_dist")])


# hourly readings to a daily map
_FINE, _COARSE = (78.55, 0.9, 0.0, 30.525, 0.0, -0.85), (78.55, 6.3, 0.0, 30.525, 0.0, -3.4)
_LAYERS = [(np.array([[3.0, -1.0], [-1.0, 0.0], [0.0, 2.0]]), np.array([0.0, -1.0])), (np.array([[2.0], [-1.5]]), np.array([0.25]))]


def _dense(x: DataFrame) -> DataFrame:
    """Rows travel through the network's key, so nothing is joined back."""
    keyed = x.withColumn("key", F.struct(*x.columns))
    return m.mlp_score(keyed, _LAYERS, ["speed", "direction", "dem"], "key").select("key.*", F.col("score").alias("prediction"))


@query(
    "w2_daily_map",
    f"""{_UV}, mw as (select (ts + interval 345 minute)::date date, lat, lon, sqrt(u * u + v * v) s, (180 + degrees(atan2(v, u))) % 360 w from uv where strftime(ts + interval 345 minute, '%H:%M:%S') between '08:30:00' and '12:30:00'),
md as (select date, lat, lon, avg(s) s, avg(w) w from mw group by 1, 2, 3),
wl as (select date, floor((lat - 30.525) / -3.4::double)::int r, floor((lon - 78.55) / 6.3::double)::int c, avg(s) speed, avg(w) direction from md group by 1, 2, 3),
cd as (select (ts + interval 345 minute)::date date, lat, lon, avg(value) v from readings join stations using (station) where variable = (select a from lim) group by 1, 2, 3),
tg as (select date, floor((lat - 30.525) / -0.85::double)::int r, floor((lon - 78.55) / 0.9::double)::int c, greatest(avg(v) - 20, 0) as value from cd group by 1, 2, 3),
dem as (select r, c, b3 v from pixels where scene = 1996),
al as (select t.*, speed, direction, dem.v dem from tg t left join wl on wl.date = t.date and wl.r = t.r // 4 and wl.c = t.c // 7
  left join dem on dem.r = floor((30.525 - (t.r + 0.5::double) * 0.85::double - 31.1) / -0.2::double) and dem.c = floor((78.55 + (t.c + 0.5::double) * 0.9::double - 78.9) / 0.4::double)),
mx as (select max(speed) ms, max(direction) mw, max(dem) mm from al),
nm as (select date, r, c, value, speed / ms s, direction / mw w, dem / mm d from al, mx)
select date, r, c, round(value, 6) as value, round(case when value = 0 then 0 else 2 / (1 + exp(-(3 * s - w))) - 1.5::double / (1 + exp(-(-s + 2 * d - 1))) + 0.25 end, 6) prediction from nm""",
)
def _(spark, d):
    x = b.readings(spark, d)
    first = x.agg(F.min("variable")).first()[0]
    values = x.filter(F.col("variable") == first).join(b.stations(spark, d), "station")
    dem = b.pixels(spark, d).filter("scene = 1996").select("r", "c", F.col("b3").alias("v"))
    got = j.daily_map(values, _uv(spark, d), _FINE, _COARSE, {"dem": p.Layer(dem, _STATIC, ())}, _dense, "Asia/Kathmandu", 20.0)
    return got.select("date", "r", "c", r6("value").alias("value"), r6("prediction").alias("prediction"))


# two scenes to areas of change
_LEVELS = (-0.015, 0.015)
_CHANGE = (
    _CTE.replace("with ", "with recursive ", 1).rstrip()
    + _superpixel_sql(3).rsplit(" select ", 1)[0]
    + f""", sg as (select scene, r, c, case when round(avg(v) over p, 9) > {_LEVELS[1]}::double then 2 when round(avg(v) over p, 9) > {_LEVELS[0]}::double then 1 else 0 end class from k3 window p as (partition by scene, sr, sc)),
ch as (select a.scene pair, a.r - y r, a.c c from sg a, (select scene % 3 y, scene from tiles group by all) o join sg z on z.scene = a.scene + 1 and z.r = a.r - y and z.c = a.c where a.scene % 2 = 0 and o.scene = a.scene and a.class - z.class = -2),
cm as (select pair, r * 8 + c p, r, c from ch),
ce as (select a.pair, a.p a, z.p b from cm a join cm z on a.pair = z.pair and abs(a.r - z.r) + abs(a.c - z.c) = 1),
cw as (select pair, p a, p b from cm union select cw.pair, cw.a, ce.b from cw join ce on ce.pair = cw.pair and ce.a = cw.b),
cl as (select pair, a, min(b) label from cw group by 1, 2)
select pair, (label // 8)::int r, (label % 8)::int c, count(*) cells, round(count(*) * 0.64::double, 6) area from cl group by pair, label"""
)


@query("w3_change_areas", _CHANGE, False)
def _(spark, d):
    """Every second scene against the next one, which starts 0, 1 or 2 rows further down."""
    t = b.tiles(spark, d)
    classes = j.segment_classes(t, lambda v: F.when(v > _LEVELS[1], 2).when(v > _LEVELS[0], 1).otherwise(0), 4, 0.2, 3)
    k = F.col("scene")
    down = F.when(k % 2 == 1, (k - 1) % 3).otherwise(0)
    scenes = t.select("scene").distinct().select("scene", F.lit(80.0).alias("t0"), F.lit(0.2).alias("t1"), (30 - down * F.lit(0.1)).alias("t3"), F.lit(-0.1).alias("t5"), F.lit(8).alias("n_rows"), F.lit(8).alias("n_cols"))
    pairs = scenes.filter("scene % 2 = 0").select(k.alias("pair"), k.alias("a"), (k + 1).alias("b"))
    got = j.change_areas(classes, pairs, scenes, -2, 0.64)
    return got.select("pair", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "cells", r6("area").alias("area"))
