"""Registered queries of regions and models, with their DuckDB twins where SQL can express them."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import grid as g
from ..operators import models as m
from ..operators import regions as x
from .queries import _CTE, QUERIES, query, r6

_HOLES = ", h as (select scene, r, c, case when (r * 3 + c * 5 + scene) % 4 > 0 then v end v from tiles)"


def _holes(spark, d) -> DataFrame:
    return b.tiles(spark, d).withColumn("v", F.when((F.col("r") * 3 + F.col("c") * 5 + F.col("scene")) % 4 > 0, F.col("v")))


def _cells(df: DataFrame) -> DataFrame:
    return df.select("scene", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), r6("v").alias("v"))


_TARGET = "t as (select scene, r, c, (r + 0.5::double) * {0}::double - 0.5 y, (c + 0.5::double) * {0}::double - 0.5 x from (select distinct scene from h), range({1}) a(r), range({1}) b(c))"


@query("e5_resample_nearest", f"{_HOLES}, {_TARGET.format(0.4, 20)} select t.scene, t.r::int r, t.c::int c, round(h.v, 6) v from t left join h on h.scene = t.scene and h.r = floor(y + 0.5) and h.c = floor(x + 0.5)")
def _(spark, d):
    return _cells(x.resample(_holes(spark, d), 0.4, 0.4, "nearest"))


@query("e5_resample_bilinear", f"{_HOLES}, {_TARGET.format(0.5, 16)} select t.scene, t.r::int r, t.c::int c, round(sum((1 - abs(y - h.r)) * (1 - abs(x - h.c)) * v) / sum((1 - abs(y - h.r)) * (1 - abs(x - h.c))), 6) v from t left join (select * from h where v is not null) h on h.scene = t.scene and abs(y - h.r) < 1 and abs(x - h.c) < 1 group by 1, 2, 3")
def _(spark, d):
    return _cells(x.resample(_holes(spark, d), 0.5, 0.5))


_KEYS = "case when {0} <= 1 then 1.5::double * {0} ** 3 - 2.5::double * {0} ** 2 + 1 else -0.5::double * {0} ** 3 + 2.5::double * {0} ** 2 - 4 * {0} + 2 end"


@query("e5_resample_cubic", f", h as (select * from tiles), {_TARGET.format(0.5, 16)}, q as (select t.scene, t.r, t.c, v, ({_KEYS.format('abs(y - h.r)')}) * ({_KEYS.format('abs(x - h.c)')}) w from t join h on h.scene = t.scene and abs(y - h.r) < 2 and abs(x - h.c) < 2) select scene, r::int r, c::int c, round(sum(w * v) / sum(w), 6) v from q group by 1, 2, 3")
def _(spark, d):
    return _cells(x.resample(b.tiles(spark, d), 0.5, 0.5, "cubic"))


@query("e6_gap_fill", f"{_HOLES}, n as (select z.scene, z.r, z.c, list_sort(list(struct_pack(d2 := (z.r - k.r) ** 2 + (z.c - k.c) ** 2, kr := k.r, kc := k.c, v := k.v)))[1:8] near from h z join h k on k.scene = z.scene where z.v is null and k.v is not null group by 1, 2, 3), u as (select scene, r, c, unnest(near) e from n), f as (select scene, r, c, sum(e.v / e.d2) / sum(1 / e.d2) fill from u group by 1, 2, 3) select h.scene, h.r, h.c, round(coalesce(h.v, fill), 6) v from h left join f on f.scene = h.scene and f.r = h.r and f.c = h.c")
def _(spark, d):
    return _cells(x.idw_fill(_holes(spark, d)))


_AREAS = _CTE.replace("with ", "with recursive ", 1).rstrip() + """, m as (select scene, r * 8 + c p, r, c from tiles where v > 0),
e as (select a.scene, a.p a, b.p b from m a join m b on a.scene = b.scene and abs(a.r - b.r) + abs(a.c - b.c) = 1),
w as (select scene, p a, p b from m union select w.scene, w.a, e.b from w join e on e.scene = w.scene and e.a = w.b),
l as (select scene, a, min(b) label from w group by 1, 2)
select scene, (label // 8)::int r, (label % 8)::int c, count(*) cells, round(count(*) * 0.64::double, 6) area from l group by scene, label"""


@query("e7_connected_areas", _AREAS, False)
def _(spark, d):
    a = x.connected_areas(b.tiles(spark, d).filter("v > 0"), 0.64)
    return a.select("scene", F.col("label.r").cast("int").alias("r"), F.col("label.c").cast("int").alias("c"), "cells", r6("area").alias("area"))


def _mrf_sql(rounds: int) -> str:
    sql = ", l0 as (select scene, r, c, v, least(1, coalesce(floor((v - min(v) over p) * 2 / nullif(max(v) over p - min(v) over p, 0)), 0))::int label from tiles window p as (partition by scene))"
    for i in range(rounds):
        score = "coalesce(round(ln(case when n{0} > 0 then n{0} / nn else 0.001::double end) - ln(greatest(s{0}, 0.001::double)) - ((v - m{0}) / greatest(s{0}, 0.001::double)) ** 2 / 2, 9), -1e300)"
        sql += f""", s{i} as (select scene, {', '.join(f'avg(v) filter (label = {k}) m{k}, stddev_pop(v) filter (label = {k}) s{k}' for k in (0, 1))} from l{i} group by 1),
n{i} as (select a.scene, a.r, a.c, a.v, count(*)::double nn, count(*) filter (b.label = 0)::double n0, count(*) filter (b.label = 1)::double n1 from l{i} a join l{i} b on a.scene = b.scene and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 and (a.r <> b.r or a.c <> b.c) group by 1, 2, 3, 4),
l{i + 1} as (select scene, r, c, v, case when {score.format(1)} > {score.format(0)} then 1 else 0 end label from n{i} join s{i} using (scene))"""
    return sql + f" select scene, r, c, label from l{rounds}"


@query("e8_contextual_relabel", _mrf_sql(3))
def _(spark, d):
    return x.mrf_relabel(b.tiles(spark, d), 2, 3, mirror=False).select("scene", "r", "c", "label")


def _superpixel_sql(rounds: int) -> str:
    sql = ", k0 as (select scene, r, c, v, r // 4 sr, c // 4 sc from tiles)"
    for i in range(rounds):
        sql += f""", c{i} as (select scene, sr, sc, avg(r) mr, avg(c) mc, avg(v) mv from k{i} group by 1, 2, 3),
k{i + 1} as (select k.scene, k.r, k.c, k.v, c.sr, c.sc from k0 k join c{i} c on k.scene = c.scene and abs(k.sr - c.sr) <= 1 and abs(k.sc - c.sc) <= 1
  qualify row_number() over (partition by k.scene, k.r, k.c order by round((v - mv) ** 2 + 0.0025::double * ((r - mr) ** 2 + (c - mc) ** 2), 9), c.sr, c.sc) = 1)"""
    return sql + f" select scene, r, c, sr::int sr, sc::int sc from k{rounds}"


@query("e9_superpixels", _superpixel_sql(3))
def _(spark, d):
    return x.superpixels(b.tiles(spark, d), 4, 0.2, 3).select("scene", "r", "c", "sr", "sc")


def _e8_whole(spark, d):
    return x.mrf_relabel(b.tiles(spark, d)).select("scene", "r", "c", "label")


def _e9_whole(spark, d):
    return x.superpixels(b.tiles(spark, d), 4, 0.2).select("scene", "r", "c", "sr", "sc")


# The SQL has one set of CTEs for each round, so it is held against three; these run all rounds and have none.
QUERIES |= {"e8_contextual_relabel_whole": _e8_whole, "e9_superpixels_whole": _e9_whole}

_OUTLINE = "case when code in (5, 7, 15, 17, 25, 27) then 1.0::double when code in (21, 33) then sqrt(2.0::double) when code in (13, 23) then (1 + sqrt(2.0::double)) / 2 else 0 end"


@query("d11_perimeter", f", q as (select scene, r, c, floor(v * 4)::int segment from tiles), n as (select a.scene, a.r, a.c, a.segment, count(b.r) n from q a left join q b on a.scene = b.scene and a.segment = b.segment and abs(a.r - b.r) + abs(a.c - b.c) = 1 group by 1, 2, 3, 4), e as (select * from n where n < 4), k as (select a.scene, a.segment, a.r, a.c, sum(case abs(a.r - b.r) + abs(a.c - b.c) when 0 then 1 when 1 then 2 else 10 end) code from e a join e b on a.scene = b.scene and a.segment = b.segment and abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by 1, 2, 3, 4) select scene, segment, round(sum({_OUTLINE}), 6) perimeter from k group by 1, 2")
def _(spark, d):
    q = b.tiles(spark, d).withColumn("segment", F.floor(F.col("v") * 4).cast("int"))
    return x.perimeter(q).select("scene", "segment", r6("perimeter").alias("perimeter"))


# models
def features(spark, d) -> DataFrame:
    """Of each part: mean quantity, discount, tax and price, and its fold."""
    f = b.table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("id")).agg(*[F.avg(F.col(a).cast("double")).alias(n) for a, n in (("l_quantity", "q"), ("l_discount", "d"), ("l_tax", "t"), ("l_extendedprice", "y"))])
    return f.withColumn("fold", g.fold(F.col("id"), 5).cast("int"))


_FEATURES = "with f as (select l_partkey::bigint id, avg(l_quantity::double) q, avg(l_discount::double) d, avg(l_tax::double) t, avg(l_extendedprice::double) y, (((l_partkey * 48271) % 2147483647) % 5)::int fold from lineitem group by l_partkey)"


@query("j6_nearest_neighbours", f"{_FEATURES}, s as (select avg(q) qm, stddev_pop(q) qs, avg(d) dm, stddev_pop(d) ds from f where fold <> 0), z as (select id, fold, y, (q - qm) / qs q, (d - dm) / ds d from f, s), n as (select a.id, b.y, row_number() over (partition by a.id order by round((a.q - b.q) ** 2 + (a.d - b.d) ** 2, 9), b.id) k from z a join z b on a.fold = 0 and b.fold <> 0) select id, round(avg(y), 4) prediction from n where k <= 5 group by 1", False)
def _(spark, d):
    z = g.standardise(features(spark, d), ["q", "d"], F.col("fold") != 0).select("id", "fold", F.array("q", "d").alias("x"), "y")
    return m.knn_regress(z.filter("fold <> 0"), z.filter("fold = 0")).select("id", F.round("prediction", 4).alias("prediction"))


@query("j8_dense_scores", f"{_FEATURES} select id, round(2 / (1 + exp(-(0.1::double * q - 20 * d))) - 3 / (1 + exp(-(0.05::double * q + 10 * t - 1))) + 0.5, 6) score from f", False)
def _(spark, d):
    layers = [(np.array([[0.1, 0.05], [-20.0, 0.0], [0.0, 10.0]]), np.array([0.0, -1.0])), (np.array([[2.0], [-3.0]]), np.array([0.5]))]
    return m.mlp_score(features(spark, d), layers, ["q", "d", "t"], "id").select("id", r6("score").alias("score"))


def _j2(spark, d):
    return m.out_of_fold(features(spark, d), m.forest_regressor(["q", "d", "t"], "y"), 5).select("id", "fold", "y", "prediction")


def _j3(spark, d):
    """Of the orders that the forest didn't see."""
    p = b.table(spark, d, "lineitem").select(g.fold(F.col("l_orderkey").cast("long"), 5).alias("fold"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0).alias("label"))
    got = m.forest_classifier(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "label").fit(p.filter("fold <> 0")).transform(p.filter("fold = 0"))
    return got.groupBy("label", "prediction").count()


def _j4(spark, d):
    f = features(spark, d)
    return m.boosted_trees(["q", "d", "t"], "y").fit(f.filter("fold <> 0")).transform(f.filter("fold = 0")).select("id", "y", "prediction")


def _j5(spark, d):
    f = features(spark, d)
    return m.bagged_trees(["q", "d", "t"], "y").fit(f.filter("fold <> 0")).transform(f.filter("fold = 0")).select("id", "y", "prediction")


def _j7(spark, d):
    f = features(spark, d)
    return m.search_boosted(f.filter("fold <> 0"), ["q", "d", "t"], "y", {"maxDepth": [2, 4], "maxIter": [10, 50]}).transform(f.filter("fold = 0")).select("id", "y", "prediction")


QUERIES |= {"j2_out_of_fold": _j2, "j3_random_forest": _j3, "j4_boosted_trees": _j4, "j5_bagged_trees": _j5, "j7_parameter_search": _j7}
