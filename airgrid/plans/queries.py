"""Registered queries over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import scalars as s
from ..operators import grid as g
from ..operators.tiles import textures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CTE = """with readings as (select user_id station, ts, event_type variable, value, (props->>'$.k')::int qc, event_id from events),
stations as (select station, 79 + (station % 13) * 0.9::double lon, 25 + (station % 7) * 0.85::double lat from (select distinct user_id station from events)),
pixels as (select year(l_shipdate)::int scene, (l_partkey % 100)::int r, l_suppkey::int c, avg(l_quantity) b1, avg(l_extendedprice / 1000) b2, avg(l_discount * 100) b3, avg(l_tax * 100) b4 from lineitem group by 1, 2, 3),
tiles as (select vec_id scene, ((i - 1) // 8)::int r, ((i - 1) % 8)::int c, embedding[i]::double v from embeddings, unnest(range(1, 65)) t(i)) """


def query(name: str, sql: str, cte: bool = True):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = (_CTE if cte else "") + sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# sources and cleaning
@query("a6_tile_to_pixels", "select scene, r, c, round(v, 6) v from tiles")
def _(spark, d):
    return b.tiles(spark, d).withColumn("v", r6("v"))


@query("a9_pixels_to_tile", "select scene, r, c, (r // 3)::int tile_r, (c // 3)::int tile_c, round(case when (r + c + scene) % 5 > 0 then v end, 6) v from tiles")
def _(spark, d):
    from ..sources.tables import pixels_to_tile

    t = pixels_to_tile(b.tiles(spark, d).filter("(r + c + scene) % 5 > 0 or r = 7 and c = 7").withColumn("v", F.when((F.col("r") + F.col("c") + F.col("scene")) % 5 > 0, F.col("v"))), side=3)
    line = t.select("scene", "tile_r", "tile_c", F.posexplode("data").alias("i", "line")).select("scene", "tile_r", "tile_c", "i", F.posexplode("line").alias("j", "v"))
    return line.select("scene", (F.col("tile_r") * 3 + F.col("i")).alias("r"), (F.col("tile_c") * 3 + F.col("j")).alias("c"), "tile_r", "tile_c", r6("v").alias("v"))


@query("b4_mask_nodata", "select scene, count(*) n, count(nullif(b3, 0)) b3, count(nullif(b4, 0)) b4 from pixels group by 1")
def _(spark, d):
    p = g.mask_nodata(b.pixels(spark, d), {"b3": F.col("b3") == 0, "b4": F.col("b4") == 0})
    return p.groupBy("scene").agg(F.count("*").alias("n"), F.count("b3").alias("b3"), F.count("b4").alias("b4"))


@query("b2_b3_positive_rows", "select station, count(*) n, round(sum(value), 4) total from readings where value > 0 and qc > 0 group by 1")
def _(spark, d):
    p = g.keep_positive(b.readings(spark, d).na.drop(subset=["value", "qc"]), "value", "qc")
    return p.groupBy("station").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("b5_b14_fill_and_clamp", "select event_id, round(greatest(coalesce(case when value > 400 then null else value end, 0) - 100, 0), 6) v from readings")
def _(spark, d):
    v = F.coalesce(F.when(F.col("value") <= 400, F.col("value")), F.lit(0.0)) - 100
    return b.readings(spark, d).select("event_id", r6(F.greatest(v, F.lit(0.0))).alias("v"))


@query("b9_time_window", "select station, count(*) n from readings where strftime(ts, '%H:%M:%S') between '08:30:00' and '12:30:00' group by 1")
def _(spark, d):
    return b.readings(spark, d).filter(F.date_format("ts", "HH:mm:ss").between("08:30:00", "12:30:00")).groupBy("station").agg(F.count("*").alias("n"))


@query("b11_first_per_station_day", "select station, date, event_id from (select station, ts::date date, event_id, row_number() over (partition by station, ts::date order by ts, event_id) k from readings) where k = 1")
def _(spark, d):
    return g.first_per_key(b.readings(spark, d).withColumn("date", F.to_date("ts")), ["station", "date"], ["ts", "event_id"]).select("station", "date", "event_id")


@query("b13_bounding_box", "select station from stations where lat between 26 and 29 and lon between 80 and 88")
def _(spark, d):
    return b.stations(spark, d).filter(F.col("lat").between(26, 29) & F.col("lon").between(80, 88)).select("station")


@query("b6_valid_pixels", "select scene, count(*) n from pixels where b4 is not null and b4 <> 0 group by 1")
def _(spark, d):
    return b.pixels(spark, d).filter("b4 is not null and not isnan(b4) and b4 <> 0").groupBy("scene").agg(F.count("*").alias("n"))


@query("b15_scene_dates", "select scene, count(*) n from pixels where scene >= 1995 group by 1")
def _(spark, d):
    return b.pixels(spark, d).filter("scene >= 1995").groupBy("scene").agg(F.count("*").alias("n"))


# stations
@query("d2_daily_station_mean", "select station, ts::date date, count(*) n, round(avg(value), 6) value from readings group by 1, 2 having count(*) >= 3")
def _(spark, d):
    return g.daily_station_mean(b.readings(spark, d), 3).withColumn("value", r6("value"))


@query("d1_daily_resample", "select s.station, s.date, round(m.value, 6) value from (select station, unnest(generate_series(min(ts::date), max(ts::date), interval 1 day))::date date from readings group by station) s left join (select station, ts::date date, avg(value) value from readings group by 1, 2) m on s.station = m.station and s.date = m.date")
def _(spark, d):
    return g.daily_resample(b.readings(spark, d)).withColumn("value", r6("value"))


@query("d3_daily_cell_mean", "select (ts + interval 345 minute)::date date, lat, lon, round(avg(value), 6) value from readings join stations using (station) group by 1, 2, 3")
def _(spark, d):
    cells = b.readings(spark, d).join(b.stations(spark, d), "station")
    return g.daily_cell_mean(cells, "Asia/Kathmandu").withColumn("value", r6("value"))


@query("d5_composite", "select station, case when m > 0.01 and m < 1 and n >= 5 then round(m, 6) end as value, n from (select station, avg(case when value > 0 then value / 500 end) m, count(case when value > 0 then 1 end) n from readings group by 1)")
def _(spark, d):
    return g.composite(b.readings(spark, d).withColumn("v", F.col("value") / 500), ["station"], "v", 5).select("station", r6("value").alias("value"), "n")


@query("d6_climatology_anomaly", "select scene, r, c, round(greatest(0, b1 - m), 6) anomaly from pixels join (select r, c, sum(b1) / count(*) m from pixels group by 1, 2) using (r, c)")
def _(spark, d):
    p = b.pixels(spark, d).withColumnRenamed("b1", "value")
    return g.climatology_anomaly(p.select("scene", "r", "c", "value"), p.select("r", "c", "value"), ["r", "c"]).select("scene", "r", "c", r6("anomaly").alias("anomaly"))


@query("d7_zonal_counts", "select c zone, count(*) filter (b1 > 0.001 and b1 <= 5) low, count(*) filter (b1 > 20 and b1 <= 25) mid, count(*) filter (b1 > 5) high, round(sum(b3) / nullif(count(*) filter (b3 <> 0), 0) * 100, 6) mean100 from pixels group by 1")
def _(spark, d):
    x = F.col("b1")
    return b.pixels(spark, d).groupBy(F.col("c").alias("zone")).agg(F.count_if((x > 0.001) & (x <= 5)).alias("low"), F.count_if((x > 20) & (x <= 25)).alias("mid"), F.count_if(x > 5).alias("high"), r6(F.try_divide(F.sum("b3"), F.count_if(F.col("b3") != 0)) * 100).alias("mean100"))


@query("d8_zonal_statistics", "select scene, c segment, round(avg(b4), 6) mean, round(stddev_pop(b4), 6) std, round(max(b4), 6) hi, round(min(b4), 6) lo from pixels group by 1, 2")
def _(spark, d):
    return b.pixels(spark, d).groupBy("scene", F.col("c").alias("segment")).agg(r6(F.avg("b4")).alias("mean"), r6(F.stddev_pop("b4")).alias("std"), r6(F.max("b4")).alias("hi"), r6(F.min("b4")).alias("lo"))


@query("d10_segment_shape", "select scene, segment, area, round(area / box, 6) extent, round(4 * sqrt(mid + off), 5) major from (select *, (rr + cc) / 2 mid, sqrt(((rr - cc) / 2) ** 2 + rc ** 2) off from (select scene, (c % 10)::int segment, count(*) area, (max(r) - min(r) + 1) * (max(c) - min(c) + 1) box, var_pop(r) rr, var_pop(c) cc, covar_pop(r, c) rc from pixels group by 1, 2))")
def _(spark, d):
    p = b.pixels(spark, d).withColumn("segment", F.col("c") % 10)
    return g.segment_shape(p, ["scene", "segment"]).select("scene", "segment", "area", r6("extent").alias("extent"), F.round("major", 5).alias("major"))


@query("d12_max_normalise", "select scene, r, c, round(b1 / (select max(b1) from pixels), 6) b1 from pixels")
def _(spark, d):
    return g.max_normalise(b.pixels(spark, d), ["b1"]).select("scene", "r", "c", r6("b1").alias("b1"))


@query("d13_min_max", "select event_id, round((value - lo) / (hi - lo), 6) v from readings, (select min(value) lo, max(value) hi from readings where ((event_id * 48271) % 2147483647) % 5 <> 0)")
def _(spark, d):
    return g.min_max(b.readings(spark, d), ["value"], g.fold(F.col("event_id"), 5) != 0).select("event_id", r6("value").alias("v"))


@query("d13_standardise", "select event_id, round((value - m) / sd, 6) v from readings, (select avg(value) m, stddev_pop(value) sd from readings where ((event_id * 48271) % 2147483647) % 5 <> 0)")
def _(spark, d):
    return g.standardise(b.readings(spark, d), ["value"], g.fold(F.col("event_id"), 5) != 0).select("event_id", r6("value").alias("v"))


@query("d14_regression_metrics", "select f fold, count(*) n, round(avg((value - p) ** 2), 4) mse, round(1 - avg((value - p) ** 2) / var_pop(value), 6) r2 from (select ((event_id * 48271) % 2147483647) % 10 f, value, value * 0.9 + qc p from readings) group by rollup (f)")
def _(spark, d):
    p = b.readings(spark, d).withColumns({"fold": g.fold(F.col("event_id"), 10), "p": F.col("value") * 0.9 + F.col("qc")})
    return g.regression_metrics(p, "value", "p").select("fold", "n", F.round("mse", 4).alias("mse"), r6("r2").alias("r2"))


@query("d15_best_checkpoint", "select fold, epoch from (select station fold, event_id epoch, row_number() over (partition by station order by value desc, event_id) k from readings where event_id > 100) where k = 1")
def _(spark, d):
    log = b.readings(spark, d).select(F.col("station").alias("fold"), F.col("event_id").alias("epoch"), F.col("value").alias("val_r2"))
    return g.best_checkpoint(log, 100).select("fold", "epoch")


@query("d20_distinct_counts", "select count(distinct station) n_stations, count(distinct ts::date) n_days from readings")
def _(spark, d):
    return b.readings(spark, d).agg(F.countDistinct("station").alias("n_stations"), F.countDistinct(F.to_date("ts")).alias("n_days"))


@query("d21_rollup_report", "select station, variable, count(*) n, round(avg(value), 9) value from readings group by rollup (station, variable)")
def _(spark, d):
    return b.readings(spark, d).rollup("station", "variable").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("value"))


@query("d22_to_byte", "select scene, r, c, floor((b1 - lo) / (hi - lo) * 255)::int v from pixels join (select scene, min(b1) lo, max(b1) hi from pixels group by 1) using (scene)")
def _(spark, d):
    p = b.pixels(spark, d)
    m = p.groupBy("scene").agg(F.min("b1").alias("lo"), F.max("b1").alias("hi"))
    return p.join(m, "scene").select("scene", "r", "c", F.floor((F.col("b1") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).cast("int").alias("v"))


# joins
@query("c1_extract_at_points", "select station, scene, round(b1, 6) b1, round(b4, 6) b4 from stations join pixels on r = trunc((lat - 31) * 0.2::double / (0.2::double * -0.1::double))::int and c = trunc((lon - 79) * -0.1::double / (0.2::double * -0.1::double))::int")
def _(spark, d):
    row, col = s.geo_to_pixel((79.0, 0.2, 0.0, 31.0, 0.0, -0.1), F.col("lon"), F.col("lat"))
    at = b.stations(spark, d).select("station", row.alias("r"), col.alias("c"))
    return at.join(b.pixels(spark, d), ["r", "c"]).select("station", "scene", r6("b1").alias("b1"), r6("b4").alias("b4"))


@query("c3_stack_layers", "select a.r, a.c, round(a.b1, 6) x, round(p.b2, 6) y, round(z.b3, 6) z from pixels a join pixels p on a.r = p.r and a.c = p.c and p.scene = 1996 join pixels z on a.r = z.r and a.c = z.c and z.scene = 1997 where a.scene = 1995")
def _(spark, d):
    p = b.pixels(spark, d)
    one = [p.filter(F.col("scene") == y).select("r", "c", r6(x).alias(n)) for y, x, n in ((1995, "b1", "x"), (1996, "b2", "y"), (1997, "b3", "z"))]
    return one[0].join(one[1], ["r", "c"]).join(one[2], ["r", "c"])


@query("c4_raster_diff", "select a.r, a.c, round(a.b1 - p.b1, 6) diff from pixels a join pixels p on a.r = p.r + 1 and a.c = p.c and p.scene = 1996 where a.scene = 1995")
def _(spark, d):
    p = b.pixels(spark, d).withColumn("v", F.col("b1"))
    return g.raster_diff(p.filter("scene = 1995"), p.filter("scene = 1996"), 1, 0).withColumn("diff", r6("diff"))


@query("c6_match_window", "select pass_id, site, round(coalesce(avg(value), 0), 6) as value, count(value) n from (select o_orderkey pass_id, o_custkey % 150 site, date '2024-01-01' + (day(o_orderdate) - 1)::int date from orders) p left join readings on station = site and ts::date = p.date and ts > p.date + interval 8 hour and ts < p.date + interval 14 hour group by 1, 2")
def _(spark, d):
    o = b.table(spark, d, "orders")
    p = o.select(F.col("o_orderkey").alias("pass_id"), (F.col("o_custkey") % 150).alias("site"), F.date_add(F.lit("2024-01-01").cast("date"), F.dayofmonth("o_orderdate") - 1).alias("date"))
    day = F.col("date").cast("timestamp_ntz")
    p = p.withColumns({"start_ts": day + F.expr("interval 10 hours"), "end_ts": day + F.expr("interval 12 hours")})
    return g.match_window(p, b.readings(spark, d), 2).withColumn("value", r6("value"))


@query("c8_dates_with_records", "select distinct l_shipdate::date date from lineitem where l_shipdate::date in (select o_orderdate::date from orders)")
def _(spark, d):
    a = b.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return a.join(b.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")), "date", "left_semi")


_HAV = "2 * 6371.0088::double * asin(least(1, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))"


@query("c9_knn_idw", f", v as (select station, avg(value) as value from readings group by 1), dd as (select a.station id, b.station, {_HAV} d, value from (select station, lon + 0.05::double lon, lat + 0.05::double lat from stations) a, stations b join v on b.station = v.station), k as (select *, row_number() over (partition by id order by d, station) n from dd) select id, round(sum(value / (d * d)) / sum(1 / (d * d)), 5) ps, round(min(d), 5) ps_dist from k where n <= 10 group by 1")
def _(spark, d):
    st = b.stations(spark, d)
    v = b.readings(spark, d).groupBy("station").agg(F.avg("value").alias("value"))
    points = st.select(F.col("station").alias("id"), (F.col("lon") + F.lit(0.05)).alias("lon"), (F.col("lat") + F.lit(0.05)).alias("lat"))
    return g.knn_idw(points, st.join(v, "station"), 10).select("id", F.round("ps", 5).alias("ps"), F.round("ps_dist", 5).alias("ps_dist"))


@query("c10_label_segments", "select c segment, arg_max(l_returnflag, k) as label from (select l_suppkey c, l_returnflag, l_orderkey * 10 + l_linenumber k from lineitem) group by 1", False)
def _(spark, d):
    """Of equal keys the first row of the table, by file and place in it, as the SQL keeps it."""
    p = b.table(spark, d, "lineitem").select("*", "_metadata.file_path", "_metadata.row_index")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    place = F.when(F.col("l_returnflag").isNotNull() & key.isNotNull(), F.struct(-key, "file_path", "row_index"))
    return p.groupBy(F.col("l_suppkey").alias("segment")).agg(F.min_by("l_returnflag", place).alias("label"))


@query("c11_paint_back", "select scene, r, c, coalesce(v, 0) v from pixels left join (select c, count(*) v from pixels where scene = 1995 group by 1 having count(*) > 5) using (c)")
def _(spark, d):
    p = b.pixels(spark, d)
    seg = p.filter("scene = 1995").groupBy("c").agg(F.count("*").alias("v")).filter("v > 5")
    return p.join(seg, "c", "left").select("scene", "r", "c", F.coalesce("v", F.lit(0)).alias("v"))


@query("c12_feature_blocks", "select * from (select c segment, round(avg(b1), 6) x from pixels where scene = 1995 group by 1) join (select c segment, round(avg(nullif(b3, 0)), 6) y from pixels where scene = 1996 group by 1) using (segment) where y is not null")
def _(spark, d):
    p = b.pixels(spark, d)
    x = p.filter("scene = 1995").groupBy(F.col("c").alias("segment")).agg(r6(F.avg("b1")).alias("x"))
    y = p.filter("scene = 1996").groupBy(F.col("c").alias("segment")).agg(r6(F.avg(F.nullif("b3", F.lit(0.0)))).alias("y"))
    return x.join(y, "segment").na.drop()


@query("c13_component_pairs", "select station, u.ts::date date, count(*) n from (select station, ts::date ts, value from readings where variable = (select min(variable) from readings)) u join (select station, ts::date ts, value from readings where variable = (select max(variable) from readings)) v using (station, ts) group by 1, 2")
def _(spark, d):
    x = b.readings(spark, d).select("station", F.to_date("ts").alias("date"), "variable")
    m = F.broadcast(x.agg(F.min("variable").alias("lo"), F.max("variable").alias("hi")))
    u = x.join(m, x.variable == m.lo).select("station", "date")
    v = x.join(m, x.variable == m.hi).select("station", "date")
    return u.join(v, ["station", "date"]).groupBy("station", "date").agg(F.count("*").alias("n"))


@query("c14_gain_lookup", "select s_suppkey, round(s_acctbal * (1 + n_regionkey * 0.1::double), 6) calibrated from supplier join nation on s_nationkey = n_nationkey", False)
def _(spark, d):
    gain = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), (1 + F.col("n_regionkey") * F.lit(0.1)).alias("gain"))
    return b.table(spark, d, "supplier").join(gain, "s_nationkey").select("s_suppkey", r6(F.col("s_acctbal") * F.col("gain")).alias("calibrated"))


@query("c16_clip", "select station, n_nationkey id from stations, nation where lon >= 79 + (n_nationkey % 5) * 2.4::double and lat >= 25 + (n_nationkey // 5) * 1.2::double and (lon - (79 + (n_nationkey % 5) * 2.4::double)) / 2.4 + (lat - (25 + (n_nationkey // 5) * 1.2::double)) / 1.2 < 0.999")
def _(spark, d):
    z = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (79 + (F.col("n_nationkey") % 5) * F.lit(2.4)).alias("x"), (25 + F.expr("n_nationkey div 5") * F.lit(1.2)).alias("y"))
    ring = F.expr("array(named_struct('x', x - 1e-9D, 'y', y - 1e-9D), named_struct('x', x + 2.3976D, 'y', y - 1e-9D), named_struct('x', x - 1e-9D, 'y', y + 1.1988D))")
    return g.clip(b.stations(spark, d), z.select("id", ring.alias("ring"))).select("station", "id")


@query("c17_ratio_match", ", a as (select vec_id i, embedding::double[] x from embeddings where vec_id % 2 = 0), o as (select vec_id j, list_transform(embedding::double[], lambda v: v + (vec_id % 7) * 0.02::double) y from embeddings), d as (select i, j, list_distance(x, y) d from a, o), k as (select *, row_number() over (partition by i order by d, j) n from d) select i, min(case when n = 1 then j end) j, round(min(case when n = 1 then d end), 6) d from k where n <= 2 group by i having min(case when n = 1 then d end) < 0.75 * min(case when n = 2 then d end)")
def _(spark, d):
    """Even vectors against moved copies of all: some copies lie near enough, others don't."""
    from ..operators.match import ratio_match

    e = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    moved = e.withColumn("x", F.transform("x", lambda v: v + (F.col("id") % 7) * F.lit(0.02)))
    return ratio_match(e.filter("id % 2 = 0"), moved, 0.75).select("i", "j", r6("d").alias("d"))


@query("c18_missing_pixels", "select scene, r, c from pixels where b3 = 0 or b4 = 0")
def _(spark, d):
    p = b.pixels(spark, d)
    return p.select("scene", "r", "c").join(p.filter("b3 <> 0 and b4 <> 0"), ["scene", "r", "c"], "left_anti")


@query("d16_consensus_filter", ", m as (select l_orderkey id, floor((l_quantity - l_tax * 100) / nullif(round(l_discount * 100) - l_linenumber, 0))::int bin from lineitem), t as (select bin from m where bin between -360 and 359 group by 1 order by count(*) desc, bin limit 1) select distinct id, bin from m join t using (bin)")
def _(spark, d):
    from ..operators.match import consensus_filter

    p = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.try_divide(F.col("l_quantity") - F.col("l_tax") * 100, F.round(F.col("l_discount") * 100) - F.col("l_linenumber")).alias("slope"))
    return consensus_filter(p).select("id", "bin").distinct()


@query("d17_purity", ", k as (select r, c, arg_max(l, n) class from (select (l_partkey % 100)::int r, l_suppkey::int c, l_returnflag l, count(*) * 10 + ascii(l_returnflag) % 7 n from lineitem group by 1, 2, 3) group by 1, 2), p as (select n_nationkey id, n_nationkey * 4 r, n_nationkey * 3 + 1 c from nation), w as (select id, class, count(*) n from p join k on abs(k.r - p.r) <= 3 and abs(k.c - p.c) <= 3 group by 1, 2) select id, round(max(n) / sum(n), 6) share from w group by 1")
def _(spark, d):
    p = b.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 100).cast("int").alias("r"), F.col("l_suppkey").cast("int").alias("c"), "l_returnflag").agg((F.count("*") * 10 + F.ascii("l_returnflag") % 7).alias("n"))
    k = p.groupBy("r", "c").agg(F.max_by("l_returnflag", "n").alias("class"))
    at = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 4).alias("r"), (F.col("n_nationkey") * 3 + 1).alias("c"))
    return g.purity(at, k).select("id", r6("share").alias("share"))


@query("d18_fit_geotransform", ", m as (select scene, var_pop(c) cc, var_pop(r) rr, covar_pop(c, r) cr, covar_pop(c, b2) cx, covar_pop(r, b2) rx, avg(c) mc, avg(r) mr, avg(b2) mx from pixels group by 1), k as (select *, (cx * rr - rx * cr) / (cc * rr - cr * cr) a, (rx * cc - cx * cr) / (cc * rr - cr * cr) b from m) select scene, round(a, 6) a, round(b, 6) b, round(mx - a * mc - b * mr, 6) o from k")
def _(spark, d):
    from ..operators.match import fit_affine

    p = b.pixels(spark, d).select("scene", F.col("r").cast("double").alias("r"), F.col("c").cast("double").alias("c"), F.col("b2").alias("x"))
    return fit_affine(p, "x").select("scene", r6("a").alias("a"), r6("b").alias("b"), r6("o").alias("o"))


@query("d19_grid_transform", ", q as (select min(lon) x, max(lat) y, (max(lon) - min(lon)) / (count(distinct lon) - 1) w, (max(lat) - min(lat)) / (count(distinct lat) - 1) h, count(distinct lon) n_cols, count(distinct lat) n_rows from stations) select round(x - w / 2, 6) t0, round(w, 6) t1, round(y + h / 2, 6) t3, round(-h, 6) t5, n_rows, n_cols from q")
def _(spark, d):
    return g.grid_transform(b.stations(spark, d)).select(*[r6(t).alias(t) for t in ("t0", "t1", "t3", "t5")], "n_rows", "n_cols")


# neighbourhoods
@query("e1_eddy", "select scene, r, c, round(greatest(0, v - (coalesce(lag(v) over (partition by scene, r order by c), v) + coalesce(lead(v) over (partition by scene, r order by c), v) + coalesce(lag(v) over (partition by scene, c order by r), v) + coalesce(lead(v) over (partition by scene, c order by r), v)) / 4), 6) eddy from tiles")
def _(spark, d):
    return g.eddy(b.tiles(spark, d)).select("scene", "r", "c", r6("eddy").alias("eddy"))


@query("e4_haar_approx", "select scene, (r // 4)::int r, (c // 4)::int c, round(sum(v) / 4, 6) v from tiles group by 1, 2, 3")
def _(spark, d):
    return g.haar_approx(b.tiles(spark, d), 2).select("scene", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), r6("v").alias("v"))


@query("e10_boundary", ", q as (select scene, r, c, floor(v * 4)::int segment from tiles) select scene, r, c, coalesce(lead(segment) over (partition by scene, r order by c) <> segment, false) or coalesce(lead(segment) over (partition by scene, c order by r) <> segment, false) edge from q")
def _(spark, d):
    return g.boundary(b.tiles(spark, d).withColumn("segment", F.floor(F.col("v") * 4).cast("int"))).select("scene", "r", "c", "edge")


def _e2_sql(levels: int, k: int) -> str:
    """Common tables up to ``gl``: counts of level pairs in mirrored windows of 8 x 8 scenes."""
    h = k // 2
    return f""", ex as (select scene, min(v) lo, max(v) hi from tiles group by 1), lv as (select scene, r, c, floor((v - lo) / ((hi + 1 - lo) / {levels}))::int i from tiles join ex using (scene)),
pr as (select scene, r, c, i, coalesce(lead(i) over (partition by scene, r order by c), i) j from lv),
wn as (select a r, b c, case when a + y < 0 then -(a + y) when a + y > 7 then 14 - (a + y) else a + y end rr, case when b + x < 0 then -(b + x) when b + x > 7 then 14 - (b + x) else b + x end cc from range(8) p(a), range(8) q(b), range({-h}, {h + 1}) t(y), range({-h}, {h + 1}) u(x)),
gl as (select scene, wn.r::int r, wn.c::int c, i, j, count(*) n from wn join pr on pr.r = wn.rr and pr.c = wn.cc group by 1, 2, 3, 4, 5)"""


@query("e2_cooccurrence_totals", _e2_sql(17, 7) + " select * from gl")
def _(spark, d):
    return g.cooccurrence(b.tiles(spark, d), 17, 7).select("scene", "r", "c", "i", "j", "n")


@query("e3_texture", _e2_sql(17, 7) + """, tx as (select scene, r, c, max(n) as max, sum(-(n / 49.0::double + 1 / 49.0::double) * ln(n / 49.0::double + 1 / 49.0::double)) + (289 - count(*)) * (ln(49.0::double) / 49) entropy, sum(n * i) / 289.0::double as mean, sum((n * i) ** 2) sq,
sum(n * (i - j) ** 2)::double contrast, sum(n * abs(i - j))::double dissimilarity, sum(n / (1 + (i - j) ** 2)) homogeneity, sum(n * n)::double asm from gl group by 1, 2, 3)
select scene, r, c, max, round(entropy, 6) entropy, round(mean, 6) as mean, round(sqrt(greatest(0, sq - 289 * mean * mean)), 6) std, round(contrast, 6) contrast, round(dissimilarity, 6) dissimilarity, round(homogeneity, 6) homogeneity, round(asm, 6) asm, round(sqrt(asm), 6) energy from tx""")
def _(spark, d):
    return textures(b.tiles(spark, d), 17, 7).select("scene", "r", "c", "max", *[r6(x).alias(x) for x in ("entropy", "mean", "std", "contrast", "dissimilarity", "homogeneity", "asm", "energy")])


# scalars
@query("h1_h4_indices", "select scene, r, c, round(coalesce((b4 - b3) / nullif(b4 + b3, 0), 0), 6) ndvi, round((b2 - b4) / nullif(b2 + b4, 0), 6) ndwi, round(b3 - b1, 6) rb, round(4 * b2 - b3 - 3 * b1, 6) grb from pixels")
def _(spark, d):
    b1, b2, b3, b4 = map(F.col, ("b1", "b2", "b3", "b4"))
    rb, grb = s.colour_differences(b3, b2, b1)
    return b.pixels(spark, d).select("scene", "r", "c", r6(s.ndvi(b4, b3)).alias("ndvi"), r6(s.ndwi(b2, b4)).alias("ndwi"), r6(rb).alias("rb"), r6(grb).alias("grb"))


@query("h5_angstrom", ", x as (select event_id, value / 500 a, (qc + 1) / 10.0::double q from readings), y as (select *, case when a > 0 and q > 0 then -ln(a / q) / ln(440.0::double / 675) end ae from x) select event_id, round(ae, 6) ae, round(a * pow(550.0::double / 440, -ae), 6) aod from y")
def _(spark, d):
    x = b.readings(spark, d).select("event_id", (F.col("value") / 500).alias("a"), ((F.col("qc") + 1) / F.lit(10.0)).alias("q"))
    ae = s.angstrom(F.col("a"), F.col("q"))
    return x.select("event_id", r6(ae).alias("ae"), r6(s.aod550(F.col("a"), ae)).alias("aod"))


@query("h6_wind", ", x as (select event_id, value - 200 u, qc - 50.0::double v from readings) select event_id, round(sqrt(u * u + v * v), 6) speed, round((180 + degrees(atan2(v, u))) % 360, 5) direction from x")
def _(spark, d):
    u, v = F.col("value") - 200, F.col("qc") - 50.0
    return b.readings(spark, d).select("event_id", r6(s.wind_speed(u, v)).alias("speed"), F.round(s.wind_direction(u, v), 5).alias("direction"))


@query("h7_h8_surface_and_decode", "select event_id, round(value + qc + 1.375 * value, 6) pm, round(0.5 * ((case when qc = 7 then 0 else qc end) - 3), 6) decoded from readings")
def _(spark, d):
    zero = F.lit(0.0)
    return b.readings(spark, d).select("event_id", r6(s.surface_pm25(F.col("value"), F.col("qc").cast("double"), zero, zero, F.col("value"))).alias("pm"), r6(s.decode(F.col("qc"), 0.5, 3.0, 7)).alias("decoded"))


@query("h9_h10_angles", ", x as (select event_id, (event_id % 80)::double a, (event_id % 60)::double z, (event_id % 360)::double p, (event_id * 7 % 360)::double q, value i from readings), y as (select *, radians(180 - case when abs(q - p) > 180 then 360 - abs(q - p) else abs(q - p) end) ra from x) select event_id, round(degrees(acos(greatest(-1, least(1, -cos(radians(z)) * cos(radians(a)) + sin(radians(z)) * sin(radians(a)) * cos(ra))))), 4) angle, round(pi() * sqrt(1 + z * z) / nullif(i * cos(radians(a)), 0), 6) pol from y")
def _(spark, d):
    k = F.col("event_id")
    a, z, p, q = [x.cast("double") for x in (k % 80, k % 60, k % 360, (k * 7) % 360)]
    return b.readings(spark, d).select("event_id", F.round(s.scattering_angle(a, z, p, q), 4).alias("angle"), r6(s.polarised_reflectance(F.col("value"), F.lit(1.0), z, a)).alias("pol"))


@query("h11_pixel_geo", "select scene, r, c, round(79 + c * 0.25::double, 6) x, round(31 - r * 0.5::double, 6) y, r br, c bc from pixels")
def _(spark, d):
    t = (79.0, 0.25, 0.0, 31.0, 0.0, -0.5)
    x, y = s.pixel_to_geo(t, F.col("r"), F.col("c"))
    br, bc = s.geo_to_pixel(t, x, y)
    return b.pixels(spark, d).select("scene", "r", "c", r6(x).alias("x"), r6(y).alias("y"), br.alias("br"), bc.alias("bc"))


@query("h12_haversine", f"select a.station, round({_HAV}, 5) km from stations a, (select 85.0::double lon, 27.0::double lat) b")
def _(spark, d):
    return b.stations(spark, d).select("station", F.round(s.haversine(F.col("lon"), F.col("lat"), F.lit(85.0), F.lit(27.0)), 5).alias("km"))


@query("h13_solar", ", x as (select event_id, 2 * pi() * (dayofyear(ts) - 1) / 365 b, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) t from readings), y as (select event_id, t, 0.006918::double - 0.399912::double * cos(b) + 0.070257::double * sin(b) - 0.006758::double * cos(2 * b) + 0.000907::double * sin(2 * b) - 0.002697::double * cos(3 * b) + 0.00148::double * sin(3 * b) dec from x) select event_id, round(dec, 6) declination, round(degrees(asin(sin(radians(27.0)) * sin(dec) + cos(radians(27.0)) * cos(dec) * cos(radians((t / 3600 - 12) * 15)))), 5) altitude from y")
def _(spark, d):
    dec = s.declination(F.dayofyear("ts"))
    t = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return b.readings(spark, d).select("event_id", r6(dec).alias("declination"), F.round(s.solar_altitude(F.lit(27.0), dec, t), 5).alias("altitude"))


@query("h14_h16_calendar", "select distinct ts::date date, strftime(ts, '%Y%m%d') ymd, strftime(ts, '%Y%m') ym, dayofyear(ts)::int doy, round(cos(2 * pi() * month(ts) / 12), 6) season from readings")
def _(spark, d):
    return b.readings(spark, d).select(F.to_date("ts").alias("date"), F.date_format("ts", "yyyyMMdd").alias("ymd"), F.date_format("ts", "yyyyMM").alias("ym"), F.dayofyear("ts").alias("doy"), r6(F.cos(2 * F.pi() * F.month("ts") / 12)).alias("season")).distinct()


@query("h17_strings", "select distinct variable, lpad(station::varchar, 6, '0') padded, regexp_extract('POINT (' || station || ' 3)', 'POINT \\(([0-9.]+) ', 1) x from readings")
def _(spark, d):
    return b.readings(spark, d).select("variable", F.lpad(F.col("station").cast("string"), 6, "0").alias("padded"), F.regexp_extract(F.concat(F.lit("POINT ("), F.col("station").cast("string"), F.lit(" 3)")), r"POINT \(([0-9.]+) ", 1).alias("x")).distinct()


@query("h18_h19_projection", "select station, round(6371008.8::double * radians(lon) * cos(radians(lat)), 3) x, round(6371008.8::double * radians(lat), 3) y, round(ln(1 + station), 6) lp from stations")
def _(spark, d):
    x, y = s.sinusoidal(F.col("lon"), F.col("lat"))
    return b.stations(spark, d).select("station", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), r6(F.log1p("station")).alias("lp"))


@query("h20_levels", ", m as (select min(v) lo, max(v) hi from tiles) select scene, r, c, floor((v - lo) / ((hi + 1 - lo) / 17))::int k from tiles, m")
def _(spark, d):
    t = b.tiles(spark, d)
    m = F.broadcast(t.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    return t.join(m).select("scene", "r", "c", s.level(F.col("v"), F.col("lo"), F.col("hi"), 17).alias("k"))


# sets and top-k
@query("f_top_k", "select station, event_id from (select station, event_id, row_number() over (partition by station order by value desc, event_id) k from readings) where k <= 3")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("station").orderBy(F.desc("value"), "event_id")
    return b.readings(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 3").select("station", "event_id")


@query("g_set_operations", "select 'both' kind, count(*) n from (select o_custkey from orders intersect select c_custkey from customer) union all select 'never', count(*) from (select c_custkey from customer except select o_custkey from orders) union all select 'all', count(*) from (select o_custkey from orders union select c_custkey from customer)", False)
def _(spark, d):
    o, c = b.table(spark, d, "orders").select(F.col("o_custkey").alias("k")), b.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    parts = (("both", o.intersect(c)), ("never", c.subtract(o)), ("all", o.union(c).distinct()))
    out = [x.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("j1_folds", "select event_id, ((event_id * 48271) % 2147483647) % 10 fold from readings")
def _(spark, d):
    return b.readings(spark, d).select("event_id", g.fold(F.col("event_id"), 10).alias("fold"))
