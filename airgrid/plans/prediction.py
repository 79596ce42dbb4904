"""Registered queries of points, alignment, predictions, wind and segment features, with their DuckDB twins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import scalars as s
from ..operators import grid as g
from ..operators import prediction as p
from ..operators.tiles import textures
from .queries import QUERIES, _e2_sql, query, r6

# C1, B10: scenes whose grids start at different places; stations outside are lost
_SCENES = ", sc as (select distinct scene, 79.013::double + (scene % 3) * 0.5::double t0, 0.2::double t1, 31.017::double - (scene % 2) * 0.7::double t3, -0.1::double t5, 40 n_rows, 50 n_cols from pixels)"


def _scenes(spark, d) -> DataFrame:
    x = b.pixels(spark, d).select("scene").distinct()
    t = (79.013 + (F.col("scene") % 3) * F.lit(0.5), F.lit(0.2), F.lit(0.0), 31.017 - (F.col("scene") % 2) * F.lit(0.7), F.lit(0.0), F.lit(-0.1))
    return x.withColumns({f"t{i}": v.cast("double") for i, v in enumerate(t)} | {"n_rows": F.lit(40), "n_cols": F.lit(50)})


@query("c1_points_in_scenes", f"{_SCENES}, k as (select station, scene, (lat - t3) / t5 y, (lon - t0) / t1 x, n_rows, n_cols from stations, sc) select station, scene, p.r, p.c, round(b1, 6) b1, round(b4, 6) b4 from k join pixels p using (scene) where y >= 0 and y < n_rows and x >= 0 and x < n_cols and p.r = floor(y) and p.c = floor(x)")
def _(spark, d):
    got = p.extract_at_points(b.pixels(spark, d), _scenes(spark, d), b.stations(spark, d))
    return got.select("station", "scene", "r", "c", r6("b1").alias("b1"), r6("b4").alias("b4"))


@query("b10_scenes_with_stations", f"{_SCENES} select distinct scene from stations, sc where (lat - t3) / t5 >= 0 and (lat - t3) / t5 < n_rows and (lon - t0) / t1 >= 0 and (lon - t0) / t1 < n_cols and scene % 2 = 0")
def _(spark, d):
    return p.points_in_scenes(_scenes(spark, d).filter("scene % 2 = 0"), b.stations(spark, d)).select("scene").distinct()


# C2, B7, B8: a target grid, two layers on coarser grids with other corners (one static), a linear model, a mask
_TARGET, _COARSE, _STATIC = (79.0, 0.1, 0.0, 31.0, 0.0, -0.1), (79.35, 0.25, 0.0, 30.55, 0.0, -0.25), (78.9, 0.4, 0.0, 31.1, 0.0, -0.2)
_ALIGN = """, tg as (select scene, r, c, b1, 79 + (c + 0.5::double) * 0.1::double lon, 31 - (r + 0.5::double) * 0.1::double lat from pixels),
wind as (select scene, r, c, avg(b2) v from pixels group by 1, 2, 3), press as (select scene, r, c, avg(b4) v from pixels group by 1, 2, 3), dem as (select r, c, avg(b3) v from pixels where scene = 1996 group by 1, 2),
al as (select t.*, w.v wind, q.v press, m.v dem from tg t left join wind w on w.scene = t.scene and w.r = floor((lat - 30.55) / -0.25::double) and w.c = floor((lon - 79.35) / 0.25::double)
  left join press q on q.scene = t.scene and q.r = floor((lat - 30.55) / -0.25::double) and q.c = floor((lon - 79.35) / 0.25::double)
  left join dem m on m.r = floor((lat - 31.1) / -0.2::double) and m.c = floor((lon - 78.9) / 0.4::double))"""


def _aligned(spark, d) -> DataFrame:
    x = b.pixels(spark, d)
    layers = {
        "wind": p.Layer(x.select("scene", "r", "c", F.col("b2").alias("v")), _COARSE, ("scene",)),
        "press": p.Layer(x.select("scene", "r", "c", F.col("b4").alias("v")), _COARSE, ("scene",)),
        "dem": p.Layer(x.filter("scene = 1996").select("r", "c", F.col("b3").alias("v")), _STATIC, ()),
    }
    return p.align_layers(x.select("scene", "r", "c", "b1"), _TARGET, layers)


@query("c2_align_layers", f"{_ALIGN} select scene, r, c, round(b1, 9) b1, round(wind, 9) wind, round(press, 9) press, round(dem, 9) dem from al")
def _(spark, d):
    return _aligned(spark, d).select("scene", "r", "c", *[F.round(x, 9).alias(x) for x in ("b1", "wind", "press", "dem")])


@query("b7_b8_predict_and_mask", f"{_ALIGN} select scene, r, c, round(case when dem = 0 then 0 when wind is not null and press is not null and dem is not null then 2 * wind - press + b1 end, 9) prediction from al")
def _(spark, d):
    got = p.predict_present(_aligned(spark, d), ["wind", "press", "dem"], lambda x: x.withColumn("prediction", 2 * F.col("wind") - F.col("press") + F.col("b1")))
    return got.select("scene", "r", "c", F.round(p.mask_result(F.col("prediction"), F.col("dem")), 9).alias("prediction"))


# by day: lineitem cells with their dates
_DAYS = "with cells as (select l_shipdate::date date, (l_partkey % 20)::int r, (l_suppkey % 10)::int c, avg(l_quantity::double) q, avg(l_extendedprice::double / 1000) x, avg(l_discount::double * 100) k, avg(l_tax::double * 100) t from lineitem group by 1, 2, 3) "


def _cells(spark, d) -> DataFrame:
    x = b.table(spark, d, "lineitem")
    num = {n: F.avg(F.col(c).cast("double") * f) for n, c, f in (("q", "l_quantity", 1.0), ("x", "l_extendedprice", 0.001), ("k", "l_discount", 100.0), ("t", "l_tax", 100.0))}
    return x.groupBy(F.to_date("l_shipdate").alias("date"), (F.col("l_partkey") % 20).cast("int").alias("r"), (F.col("l_suppkey") % 10).cast("int").alias("c")).agg(*[e.alias(n) for n, e in num.items()])


@query("c3_stack_by_day_and_month", _DAYS + ", m as (select date_trunc('month', date)::date mon, r, c, max(k) v from cells group by 1, 2, 3) select a.date, a.r, a.c, round(a.q, 6) q, round(o.x, 6) x, round(m.v, 6) ndvi from cells a join cells o on a.date = o.date and a.r = o.r and a.c = o.c and o.r < 15 and o.c < 8 join m on m.mon = date_trunc('month', a.date)::date and m.r = a.r and m.c = a.c", False)
def _(spark, d):
    x = _cells(spark, d)
    month = x.groupBy(F.trunc("date", "month").alias("date"), "r", "c").agg(F.max("k").alias("v"))
    got = p.stack_layers({"q": x.select("date", "r", "c", F.col("q").alias("v")), "x": x.filter("r < 15 and c < 8").select("date", "r", "c", F.col("x").alias("v")), "ndvi": month}, ("ndvi",))
    return got.select("date", "r", "c", r6("q").alias("q"), r6("x").alias("x"), r6("ndvi").alias("ndvi"))


@query("c5_d6_climatology_by_day", _DAYS + ", h as (select month(date) m, day(date) dd, r, c, sum(q) / count(*) v from cells group by 1, 2, 3, 4) select date, cells.r, cells.c, round(greatest(0, q - v), 6) anomaly from cells join h on h.m = month(date) and h.dd = day(date) and h.r = cells.r and h.c = cells.c where year(date) = 1997", False)
def _(spark, d):
    x = _cells(spark, d).select("date", F.month("date").alias("month"), F.dayofmonth("date").alias("day"), "r", "c", F.col("q").alias("value"))
    got = g.climatology_anomaly(x.filter("year(date) = 1997"), x.drop("date"), ["month", "day", "r", "c"])
    return got.select("date", "r", "c", r6("anomaly").alias("anomaly"))


@query("a11_merge_datasets", ", u as (select r, c, avg(b1) v from pixels where scene = 1995 group by 1, 2), w as (select r, c, avg(b2) v from pixels where scene = 1996 group by 1, 2), z as (select r, c, avg(b3) v from pixels where scene = 1997 group by 1, 2) select r, c, round(u.v, 9) u, round(w.v, 9) w, round(z.v, 9) z from u full join w using (r, c) full join z using (r, c)")
def _(spark, d):
    x = b.pixels(spark, d)
    got = p.merge_datasets({n: x.filter(F.col("scene") == y).select("r", "c", F.col(band).alias("v")) for n, y, band in (("u", 1995, "b1"), ("w", 1996, "b2"), ("z", 1997, "b3"))})
    return got.select("r", "c", *[F.round(n, 9).alias(n) for n in "uwz"])


# wind
_UV = ", cl as (select date_trunc('hour', ts) ts, lat, lon, variable, max(value) - 200 as value from readings join stations using (station) group by 1, 2, 3, 4), lim as (select min(variable) a, max(variable) z from readings), uv as (select u.ts, u.lat, u.lon, u.value u, v.value v from cl u join cl v on u.ts = v.ts and u.lat = v.lat and u.lon = v.lon and u.variable = (select a from lim) and v.variable = (select z from lim))"


def _uv(spark, d) -> DataFrame:
    x = b.readings(spark, d)
    a, z = x.agg(F.min("variable"), F.max("variable")).first()
    cells = x.join(b.stations(spark, d), "station").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "lat", "lon", "variable").agg((F.max("value") - 200).alias("value"))
    return p.pair_components(cells, a, z)


@query("c13_wind_pairs", f"{_UV} select ts::date date, count(*) n, round(sum(u), 4) u, round(sum(v), 4) v from uv group by 1")
def _(spark, d):
    return _uv(spark, d).groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.round(F.sum("u"), 4).alias("u"), F.round(F.sum("v"), 4).alias("v"))


@query("d4_morning_wind", f"{_UV}, lo as (select *, ts + interval 345 minute l from uv) select l::date date, lat, lon, round(avg(sqrt(u * u + v * v)), 5) speed, round(avg((180 + degrees(atan2(v, u))) % 360), 4) direction from lo where strftime(l, '%H:%M:%S') between '08:30:00' and '12:30:00' group by 1, 2, 3")
def _(spark, d):
    return p.morning_wind(_uv(spark, d), "Asia/Kathmandu").select("date", "lat", "lon", F.round("speed", 5).alias("speed"), F.round("direction", 4).alias("direction"))


# segments
# decimals of limited length can end on a tie of the last digit; a small number of more digits keeps them off it
_OFF = 2.345678e-10
_STATS = ", ".join(f"round({f}({{0}}) + {_OFF}::double, 7) {{0}}_{n}" for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("max", "max"), ("min", "min")))
_SPECTRAL = ("b1", "b2", "b3", "b4", "ndvi", "ndwi", "kt1", "kt2")


@query("d8_h3_spectral_statistics", ", x as (select *, coalesce((b4 - b3) / nullif(b4 + b3, 0), 0) ndvi, (b2 - b4) / nullif(b2 + b4, 0) ndwi, 0.326::double * b1 + 0.509::double * b2 + 0.56::double * b3 + 0.567::double * b4 kt1, -0.311::double * b1 - 0.356::double * b2 - 0.325::double * b3 + 0.819::double * b4 kt2 from pixels) select scene, c segment, " + ", ".join(_STATS.format(c) for c in _SPECTRAL) + " from x group by 1, 2")
def _(spark, d):
    b1, b2, b3, b4 = map(F.col, ("b1", "b2", "b3", "b4"))
    kt1, kt2 = s.tasselled_cap(b1, b2, b3, b4)
    got = p.zonal_statistics(b.pixels(spark, d).withColumnRenamed("c", "segment"), ["scene", "segment"], {"b1": b1, "b2": b2, "b3": b3, "b4": b4, "ndvi": s.ndvi(b4, b3), "ndwi": s.ndwi(b2, b4), "kt1": kt1, "kt2": kt2})
    return got.select("scene", "segment", *[F.round(F.col(c) + _OFF, 7).alias(c) for c in got.columns[2:]])


@query("d9_zonal_texture", f"{_e2_sql(17, 7)}, m as (select scene, r, c, sum(n * i) / 289.0::double glcm from gl group by 1, 2, 3), q as (select scene, r, c, floor(v * 4)::int segment from tiles) select scene, segment, {_STATS.format('glcm')} from m join q using (scene, r, c) group by 1, 2")
def _(spark, d):
    t = b.tiles(spark, d)
    mean = textures(t, 17, 7).select("scene", "r", "c", F.col("mean").alias("glcm"))
    got = p.zonal_statistics(mean.join(t.withColumn("segment", F.floor(F.col("v") * 4).cast("int")), ["scene", "r", "c"]), ["scene", "segment"], {"glcm": F.col("glcm")})
    return got.select("scene", "segment", *[F.round(F.col(c) + _OFF, 7).alias(c) for c in got.columns[2:]])


def _d11(spark, d):
    q = b.tiles(spark, d).withColumn("segment", F.floor(F.col("v") * 4).cast("int"))
    return p.convex_area(q).select("scene", "segment", r6("convex_area").alias("convex_area"))


#: A hull is found in order of its points, which SQL can't say; tests hold it against all triples of points.
QUERIES["d11_convex_area"] = _d11


@query("d7_zonal_counts_in_zones", ", z as (select n_nationkey zone, n_nationkey % 5 zr, n_nationkey // 5 zc from nation), x as (select zone, b1, b3 from pixels join z on r // 20 = zr and c // 20 = zc) select zone, count(*) filter (b1 > 0.001 and b1 <= 5) n1, count(*) filter (b1 > 20 and b1 <= 25) n2, count(*) filter (b1 > 25 and b1 <= 30) n3, count(*) filter (b1 > 5) n4, round(coalesce(sum(b3) / nullif(count(*) filter (b3 <> 0), 0), 0) * 100, 5) mean100 from x group by 1")
def _(spark, d):
    z = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), (F.col("n_nationkey") % 5).alias("zr"), F.expr("n_nationkey div 5").alias("zc"))
    x = b.pixels(spark, d).withColumns({"zr": F.expr("r div 20"), "zc": F.expr("c div 20")}).join(z, ["zr", "zc"])
    inf = float("inf")
    return g.zonal_counts(x, ["zone"], "b1", "b3", [(0.001, 5), (20, 25), (25, 30), (5, inf)]).withColumn("mean100", F.round("mean100", 5))


@query("d12_max_normalise_codes", "select scene, r, c, round(round(b3) / (select max(round(b3)) from pixels), 6) b3, round(b1 / (select max(b1) from pixels), 6) b1 from pixels")
def _(spark, d):
    return g.max_normalise(b.pixels(spark, d), ["b1", "b3"], ("b3",)).select("scene", "r", "c", r6("b3").alias("b3"), r6("b1").alias("b1"))


# samples and their predictions
@query("j9_d14_class_samples", ", u as (select 0 label, b1, b2, case when b1 > 25 then 1 else 0 end prediction from pixels where scene = 1995 union all select 1, b1, null, case when b1 > 25 then 1 else 0 end from pixels where scene = 1996) select label, count(*) n, count(b2) with_b2, round(avg((label = prediction)::int), 6) accuracy from u group by 1")
def _(spark, d):
    x = b.pixels(spark, d)
    u = p.class_samples({0: x.filter("scene = 1995").select("b1", "b2"), 1: x.filter("scene = 1996").select("b1")}).withColumn("prediction", (F.col("b1") > 25).cast("int"))
    return p.accuracy(u, by=["label"]).join(u.groupBy("label").agg(F.count("b2").alias("with_b2")), "label").select("label", "n", "with_b2", r6("accuracy").alias("accuracy"))


# calendar and units
@query("h13_hour_angle", ", e as (select event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) t, (event_id % 17) * 60 eot, case event_id % 3 when 0 then '+' when 1 then '-' end sign from readings) select event_id, round(((case sign when '+' then t + eot when '-' then t - eot end)::double / 3600 - 12) * 15, 6) angle, round(((case sign when '+' then t + eot when '-' then t - eot end)::double / 36000 - 12) * 15, 6) legacy from e")
def _(spark, d):
    t = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    sign = F.when(F.col("event_id") % 3 == 0, "+").when(F.col("event_id") % 3 == 1, "-")
    eot = (F.col("event_id") % 17) * 60
    return b.readings(spark, d).select("event_id", r6(s.hour_angle(t, eot, sign)).alias("angle"), r6(s.hour_angle(t, eot, sign, True)).alias("legacy"))


@query("h14_codes", "select distinct l_shipdate::date date, round(cos(2 * pi() * month(l_shipdate) / 12), 6) season, round((year(l_shipdate) - 1995) / (select stddev_pop(y) from range(1993, 1998) t(y)), 6) code from lineitem", False)
def _(spark, d):
    x = b.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return x.select("date", r6(s.season_code(F.col("date"))).alias("season"), r6(s.year_code(F.col("date"), 1993, 1997)).alias("code"))


@query("h16_everyday", "select y.o as year, strftime(unnest(generate_series(make_date(y.o, 2, 20), make_date(y.o, 3, 4), interval 1 day)), '%Y%m%d') as day from (select distinct year(o_orderdate) o from orders) y", False)
def _(spark, d):
    y = b.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return y.select("year", F.explode(s.everyday(F.col("year"), F.concat(F.col("year").cast("string"), F.lit("0220")), F.concat(F.col("year").cast("string"), F.lit("0304")))).alias("day"))


@query("h7_h11_units_and_wrap", "select event_id, round(value * 100, 4) pm, round(value / 500 * 1000, 6) aod, round(-180 + ((event_id * 7 + 180) % 360), 6) lon from readings")
def _(spark, d):
    pm, aod = s.model_units(F.col("value"), F.col("value") / 500)
    return b.readings(spark, d).select("event_id", F.round(pm, 4).alias("pm"), r6(aod).alias("aod"), r6(s.wrap_longitude(F.col("event_id") * 7, -180.0)).alias("lon"))


