"""Registered queries of offsets, edges, gaps, covers, sketches, nulls and names, with their DuckDB twins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import scalars as s
from ..operators import grid as g
from ..operators import models as m
from ..operators import regions as x
from ..operators import tiles as t
from ..sources.tables import tile_to_pixels
from .queries import QUERIES, query, r6
from .regions import _HOLES, _cells, _holes, features


# scenes of other origins
_GRIDS = ", sc as (select distinct scene, case when scene = 1998 then 300 else 79 end + (scene % 3) * 0.4::double t0, 0.2::double t1, 31 - (scene % 2) * 0.7::double t3, -0.1::double t5, 40 n_rows, 45 + scene % 2 n_cols from pixels)"


@query("c4_scene_diff", f"{_GRIDS}, k as (select a.scene pair, a.t0, a.t3, a.scene a, o.scene o, round((o.t3 - a.t3) / -0.1)::int dr, round((o.t0 - a.t0) / 0.2)::int dc, a.n_cols an, o.n_cols bn from sc a join sc o on o.scene = a.scene + 1), z as (select *, greatest(0, dr) r0, greatest(0, dc) c0, least(40, 40 + dr) r1, least(an, bn + dc) c1 from k) select pair, (p.r - r0)::int r, (p.c - c0)::int c, round(t0 + p.c * 0.2::double, 6) lon, round(t3 - p.r * 0.1::double, 6) lat, round(p.b1 - q.b1, 6) diff from z join pixels p on p.scene = a and p.r >= r0 and p.r < r1 and p.c >= c0 and p.c < c1 join pixels q on q.scene = o and q.r = p.r - dr and q.c = p.c - dc")
def _(spark, d):
    pixels = b.pixels(spark, d).withColumn("v", F.col("b1"))
    k = F.col("scene")
    scenes = pixels.select("scene").distinct().select("scene", (F.when(k == 1998, 300).otherwise(79) + (k % 3) * F.lit(0.4)).alias("t0"), F.lit(0.2).alias("t1"), (31 - (k % 2) * F.lit(0.7)).alias("t3"), F.lit(-0.1).alias("t5"), F.lit(40).alias("n_rows"), (45 + k % 2).alias("n_cols"))
    pairs = scenes.select(F.col("scene").alias("pair"), F.col("scene").alias("a"), (k + 1).alias("b"))
    got = g.scene_diff(pairs, scenes, pixels.select("scene", "r", "c", "v"))
    return got.select("pair", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), r6("lon").alias("lon"), r6("lat").alias("lat"), r6("diff").alias("diff"))


# pairs of levels at other distances and angles
def _pairs_sql(levels: int, k: int, dr: int, dc: int, name: str) -> str:
    h = k // 2
    return f"""select '{name}' as pair, scene, wn.r::int r, wn.c::int c, i, j, count(*) n from (select a r, b c, case when a + y < 0 then -(a + y) when a + y > 7 then 14 - (a + y) else a + y end rr, case when b + x < 0 then -(b + x) when b + x > 7 then 14 - (b + x) else b + x end cc
from range(8) p(a), range(8) q(b), range({-h}, {h + 1}) t(y), range({-h}, {h + 1}) u(x)) wn join (select a.scene, a.r, a.c, a.i, o.i j from lv a join lv o on o.scene = a.scene and o.r = greatest(0, least(7, a.r + {dr})) and o.c = greatest(0, least(7, a.c + {dc}))) pr on pr.r = wn.rr and pr.c = wn.cc group by 1, 2, 3, 4, 5, 6"""


_PAIRS = {"1_45": (1, 45, -1, 1), "1_90": (1, 90, -1, 0), "1_135": (1, 135, -1, -1), "2_0": (2, 0, 0, 2), "2_90": (2, 90, -2, 0)}


@query("e2_cooccurrence_angles", ", ex as (select scene, min(v) lo, max(v) hi from tiles group by 1), lv as (select scene, r, c, floor((v - lo) / ((hi + 1 - lo) / 9))::int i from tiles join ex using (scene)) " + " union all ".join(_pairs_sql(9, 5, dr, dc, name) for name, (_, _, dr, dc) in _PAIRS.items()))
def _(spark, d):
    """Tiles of 5 cells a side, so that windows reach over tiles."""
    pairs = {name: (distance, angle) for name, (distance, angle, _, _) in _PAIRS.items()}
    return t.cooccurrences(b.tiles(spark, d), 9, 5, pairs, tile=5)


# grids of odd sizes
@query("e4_haar_odd", ", o as (select *, case when r = 6 then 2 else 1 end * case when c = 4 then 2 else 1 end w from tiles where r < 7 and c < 5), h1 as (select scene, r // 2 r, c // 2 c, sum(v * w) / 2 v from o group by 1, 2, 3), h2 as (select scene, r // 2 r, c // 2 c, sum(v * case when c = 2 then 2 else 1 end) / 2 v from h1 group by 1, 2, 3) select 1 as level, scene, r::int r, c::int c, round(v, 6) v from h1 union all select 2, scene, r::int, c::int, round(v, 6) from h2")
def _(spark, d):
    odd = b.tiles(spark, d).filter("r < 7 and c < 5")
    one, two = (_cells(g.haar_approx(odd, k)).select(F.lit(k).alias("level"), "scene", "r", "c", "v") for k in (1, 2))
    return one.union(two)


# relabelling with mirrored edges and holes
def _mirrored_sql(rounds: int) -> str:
    sql = _HOLES + ", o as (select y, x from range(-1, 2) a(y), range(-1, 2) b(x) where y <> 0 or x <> 0), l0 as (select scene, r, c, v, least(1, coalesce(floor((v - min(v) over p) * 2 / nullif(max(v) over p - min(v) over p, 0)), 0))::int label from h where v is not null window p as (partition by scene))"
    for i in range(rounds):
        score = "coalesce(round(ln(case when n{0} > 0 then n{0} / nn else 0.001::double end) - ln(greatest(s{0}, 0.001::double)) - ((v - m{0}) / greatest(s{0}, 0.001::double)) ** 2 / 2, 9), -1e300)"
        sql += f""", s{i} as (select scene, {', '.join(f'avg(v) filter (label = {k}) m{k}, stddev_pop(v) filter (label = {k}) s{k}' for k in (0, 1))} from l{i} group by 1),
n{i} as (select a.scene, a.r, a.c, a.v, count(b.label)::double nn, count(*) filter (b.label = 0)::double n0, count(*) filter (b.label = 1)::double n1 from l{i} a cross join o left join l{i} b on a.scene = b.scene and b.r = 7 - abs(7 - abs(a.r + y)) and b.c = 7 - abs(7 - abs(a.c + x)) group by 1, 2, 3, 4),
l{i + 1} as (select scene, r, c, v, case when {score.format(1)} > {score.format(0)} then 1 else 0 end label from n{i} join s{i} using (scene))"""
    return sql + f" select scene, r, c, label from l{rounds}"


@query("e8_mirrored_relabel", _mirrored_sql(3))
def _(spark, d):
    return x.mrf_relabel(_holes(spark, d), 2, 3).select("scene", "r", "c", "label")


def _e6_radial(spark, d) -> DataFrame:
    return _cells(t.radial_fill(_holes(spark, d)))


def _j7_random(spark, d) -> DataFrame:
    f = features(spark, d)
    best = m.search_random(f.filter("fold <> 0"), ["q", "d", "t"], "y", {"maxIter": range(2, 8), "maxDepth": range(1, 4)}, draws=4, folds=3)
    return best.transform(f.filter("fold = 0")).select("id", "y", "prediction")


#: Systems of equations and trained trees have no SQL; tests hold them against numpy and the mean.
QUERIES |= {"e6_radial_fill": _e6_radial, "j7_random_search": _j7_random}


# polygons
_RING = ((0.0, 0.0), (2.1, 0.0), (2.1, 0.4), (0.9, 0.5), (1.3, 1.1), (0.0, 1.0))


@query("c16_clip_cover", f", g as (select i, x, y from (values {', '.join(f'({i}, {px}::double, {py}::double)' for i, (px, py) in enumerate(_RING))}) v(i, x, y)), e as (select a.x x1, a.y y1, o.x x2, o.y y2 from g a join g o on o.i = (a.i + 1) % 6), z as (select n_nationkey id, 79.0123457::double + (n_nationkey % 5) * 2.4::double px, 25.0123457::double + (n_nationkey // 5) * 1.2::double py from nation), q as (select event_id, 79 + (event_id * 7919 % 12007) / 1000.0::double lon, 25 + (event_id * 104729 % 6007) / 1000.0::double lat from events) select event_id, id from q, z, e where (y1 > lat - py) <> (y2 > lat - py) and lon - px < (x2 - x1) * (lat - py - y1) / nullif(y2 - y1, 0) + x1 group by 1, 2 having count(*) % 2 = 1")
def _(spark, d):
    k = F.col("event_id")
    points = b.table(spark, d, "events").select("event_id", (79 + (k * 7919 % 12007) / F.lit(1000.0)).alias("lon"), (25 + (k * 104729 % 6007) / F.lit(1000.0)).alias("lat"))
    px, py = F.lit(79.0123457) + (F.col("n_nationkey") % 5) * F.lit(2.4), F.lit(25.0123457) + F.expr("n_nationkey div 5") * F.lit(1.2)
    ring = F.array(*[F.struct((px + cx).alias("x"), (py + cy).alias("y")) for cx, cy in _RING])
    return g.clip(points, b.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), ring.alias("ring")), 0.1).select("event_id", "id")


# reports
@query("d21_grouping_sets", ", q as (select station, case when event_id % 9 > 0 then variable end variable, value from readings) select station, variable, grouping_id(station, variable)::bigint as grouping, count(*) n, round(avg(value), 9) as value from q group by grouping sets ((station, variable), (station), (variable), ())")
def _(spark, d):
    x = b.readings(spark, d).withColumn("variable", F.when(F.col("event_id") % 9 > 0, F.col("variable")))
    return g.grouped_report(x, [("station", "variable"), ("station",), ("variable",), ()]).withColumn("value", F.round("value", 9))


@query("d20_distinct_sketches", "select station, count(distinct event_id) exact, true as near from readings group by 1 union all select null, count(distinct event_id), true from readings")
def _(spark, d):
    """Days' sketches alone give the stations' and the total count, within 3 % of the exact ones."""
    x = b.readings(spark, d)
    days = g.distinct_sketches(x.withColumn("date", F.to_date("ts")), ["station", "date"], F.col("event_id"))
    near = (F.abs(F.col("n") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near")
    each = x.groupBy("station").agg(F.countDistinct("event_id").alias("exact")).join(g.merge_sketches(days, ["station"]), "station")
    total = x.agg(F.countDistinct("event_id").alias("exact")).crossJoin(g.merge_sketches(days, []))
    return each.select("station", "exact", near).unionByName(total.select(F.lit(None).cast("long").alias("station"), "exact", near))


@query("d10_segment_axes", "select scene, segment, round(4 * sqrt(greatest(0, mid - off)), 5) minor from (select *, (rr + cc) / 2 mid, sqrt(((rr - cc) / 2) ** 2 + rc ** 2) off from (select scene, (c % 10)::int segment, var_pop(r) rr, var_pop(c) cc, covar_pop(r, c) rc from pixels group by 1, 2))")
def _(spark, d):
    p = b.pixels(spark, d).withColumn("segment", F.col("c") % 10)
    return g.segment_shape(p, ["scene", "segment"]).select("scene", "segment", F.round("minor", 5).alias("minor"))


@query("d17_pure_windows", ", k as (select distinct r, c, ((r // 9 + c // 8) % 3)::int class from pixels), p as (select n_nationkey id, n_nationkey * 4 r, n_nationkey * 3 + 1 c from nation), w as (select id, class, count(*) n from p join k on abs(k.r - p.r) <= 3 and abs(k.c - p.c) <= 3 group by 1, 2) select id, round(max(n) / sum(n), 6) share, max(n) / sum(n) > 0.75 pure from w group by 1")
def _(spark, d):
    k = b.pixels(spark, d).select("r", "c", ((F.expr("r div 9") + F.expr("c div 8")) % 3).alias("class")).distinct()
    at = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 4).alias("r"), (F.col("n_nationkey") * 3 + 1).alias("c"))
    return g.purity(at, k).select("id", r6("share").alias("share"), "pure")


@query("f4_epochs_and_tail", ", l as (select station fold, event_id epoch, row_number() over (partition by station order by event_id) k from readings) select 'range' kind, fold, epoch from l where epoch between 100 and 300 union all select 'tail', fold, epoch from l where k > 40")
def _(spark, d):
    log = b.readings(spark, d).select(F.col("station").alias("fold"), F.col("event_id").alias("epoch"))
    parts = [f.select(F.lit(kind).alias("kind"), "fold", "epoch") for kind, f in (("range", g.epochs(log, 100, 300)), ("tail", g.tail(log, 40)))]
    return parts[0].union(parts[1])


# nulls
@query("d13_min_max_nulls", ", q as (select event_id, case when event_id % 7 > 0 then value end x, case when event_id % 11 > 0 then 4.0::double end k from readings), l as (select min(x) lo, max(x) hi from q where ((event_id * 48271) % 2147483647) % 5 <> 0) select event_id, round((x - lo) / (hi - lo), 6) x, k - 4 k from q, l")
def _(spark, d):
    q = b.readings(spark, d).select("event_id", F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("x"), F.when(F.col("event_id") % 11 > 0, 4.0).alias("k"))
    return g.min_max(q, ["x", "k"], g.fold(F.col("event_id"), 5) != 0).select("event_id", r6("x").alias("x"), "k")


@query("h9_h12_nulls", ", x as (select event_id, case when event_id % 5 > 0 then (event_id % 80)::double end a, (event_id % 60)::double z, case when event_id % 7 > 0 then (event_id % 360)::double end p, (event_id * 7 % 360)::double q from readings), y as (select *, 180 - case when abs(q - p) > 180 then 360 - abs(q - p) else abs(q - p) end ra, 180 - radians(abs(q - p)) rl from x) select event_id, round(degrees(acos(case when p + a is not null then greatest(-1, least(1, -cos(radians(z)) * cos(radians(a)) + sin(radians(z)) * sin(radians(a)) * cos(radians(ra)))) end)), 4) angle, round(degrees(acos(case when p + a is not null then greatest(-1, least(1, -cos(radians(z)) * cos(radians(a)) + sin(radians(z)) * sin(radians(a)) * cos(rl))) end)), 4) legacy, round(2 * 6371.0088::double * asin(case when p + a is not null then least(1, sqrt(sin(radians(z - a) / 2) ** 2 + cos(radians(a)) * cos(radians(z)) * sin(radians(q - p) / 2) ** 2)) end), 5) km from y")
def _(spark, d):
    k = F.col("event_id")
    a, z, p, q = F.when(k % 5 > 0, (k % 80).cast("double")), (k % 60).cast("double"), F.when(k % 7 > 0, (k % 360).cast("double")), ((k * 7) % 360).cast("double")
    return b.readings(spark, d).select("event_id", F.round(s.scattering_angle(a, z, p, q), 4).alias("angle"), F.round(s.scattering_angle(a, z, p, q, True), 4).alias("legacy"), F.round(s.haversine(p, a, q, z), 5).alias("km"))


@query("h13_solar_position", ", x as (select event_id, radians(27.0::double) la, (event_id % 47 - 23) * 0.0174::double de, (event_id % 24 - 12) * 0.2617::double t from readings), y as (select *, sin(la) * sin(de) + cos(la) * cos(de) * cos(t) s from x) select event_id, round(asin(s), 6) altitude, round((s * sin(la) - sin(de)) / (cos(asin(s)) * cos(la)), 6) azimuth, round(s, 6) legacy_altitude, round((sin(s) * sin(la) - sin(de)) / (cos(s) * cos(la)), 6) legacy_azimuth from y")
def _(spark, d):
    k = F.col("event_id")
    at = F.radians(F.lit(27.0)), (k % 47 - 23) * F.lit(0.0174), (k % 24 - 12) * F.lit(0.2617)
    values = [*s.solar_position(*at), *s.solar_position(*at, legacy=True)]
    return b.readings(spark, d).select("event_id", *[r6(v).alias(n) for v, n in zip(values, ("altitude", "azimuth", "legacy_altitude", "legacy_azimuth"))])


@query("h5_station_exponent", ", x as (select event_id, value / 500 a, case when qc % 3 > 0 then qc / 40.0::double end e from readings) select event_id, round(case when e is null then 0 else a * pow(550.0::double / 440, -e) end, 6) aod from x")
def _(spark, d):
    e = F.when(F.col("qc") % 3 > 0, F.col("qc") / F.lit(40.0))
    return b.readings(spark, d).select("event_id", r6(s.station_aod550(F.col("value") / 500, e)).alias("aod"))


# names
@query("h17_names", """, n as (select distinct '/data/' || variable || '/GF1_' || strftime(ts, '%Y%m%d') || '_' || variable || case station % 3 when 0 then '.tif' when 1 then '.tar.gz' else '' end p, 'POINT (' || station || '.25 -' || (station % 9) || ')' w from readings)
select p, w, regexp_extract(p, '[^/]*$') full_name, case when p like '%.tif' then regexp_extract(p, '[^/]*$')[:-5] when p like '%.gz' then regexp_extract(p, '[^/]*$')[:-4] else regexp_extract(p, '[^/]*$') end base, case when p like '%.tif' then '.tif' when p like '%.gz' then '.gz' else '' end ext, p like '%/GF1_%view%.tif' hit, strptime(regexp_extract(p, '_(\\d{8})_', 1), '%Y%m%d')::date as date, regexp_extract(w, '\\((\\S+) ', 1)::double x, regexp_extract(w, ' (\\S+)\\)', 1)::double y from n""")
def _(spark, d):
    tail = F.when(F.col("station") % 3 == 0, ".tif").when(F.col("station") % 3 == 1, ".tar.gz").otherwise("")
    k = F.col("station")
    path = F.concat(F.lit("/data/"), "variable", F.lit("/GF1_"), F.date_format("ts", "yyyyMMdd"), F.lit("_"), "variable", tail)
    n = b.readings(spark, d).select(path.alias("p"), F.concat(F.lit("POINT ("), k.cast("string"), F.lit(".25 -"), (k % 9).cast("string"), F.lit(")")).alias("w")).distinct()
    p, (px, py) = F.col("p"), s.point_of(F.col("w"))
    return n.select("p", "w", F.regexp_extract(p, "[^/]*$", 0).alias("full_name"), s.base_name(p).alias("base"), s.extension(p).alias("ext"), s.name_has(p, "GF1_", "view", ".tif").alias("hit"), s.date_in(p).alias("date"), px.alias("x"), py.alias("y"))


# tables
@query("b1_select_features", "select l_orderkey, l_linenumber, l_tax::double l_tax, l_discount::double l_discount, l_extendedprice::double l_extendedprice from lineitem", False)
def _(spark, d):
    return g.select_features(b.table(spark, d, "lineitem"), ["l_tax", "l_discount"], "l_extendedprice", "l_orderkey", "l_linenumber")


@query("a6_tiles_to_cells", "select vec_id, ((i - 1) // 16)::int r, ((i - 1) % 16)::int c, round(embedding[i]::double, 6) v from embeddings, unnest(range(1, 65)) t(i)", False)
def _(spark, d):
    return tile_to_pixels(b.table(spark, d, "embeddings"), 16, "embedding", "vec_id").withColumn("v", r6("v"))
