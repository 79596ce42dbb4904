"""Cleaning, joins, aggregations and neighbourhood operators on station and pixel tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine
from .match import candidates
from .tiles import cooccurrence as cooccurrence


# cleaning
def mask_nodata(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Null where a column's rule holds; NaN and infinities always."""
    bad = {c: F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))) | F.coalesce(rule, F.lit(False)) for c, rule in rules.items()}
    return df.withColumns({c: F.when(~x, F.col(c)) for c, x in bad.items()})


def keep_positive(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in columns]))


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


# stations
def daily_station_mean(df: DataFrame, min_rows: int = 21) -> DataFrame:
    """station, date, n, value: days with at least ``min_rows`` rows; nulls count as rows but not in the mean."""
    g = df.groupBy("station", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return g.filter(F.col("n") >= min_rows)


def daily_resample(df: DataFrame) -> DataFrame:
    """Mean for each station and calendar day between its first and last; days without rows are null."""
    daily = df.groupBy("station", F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"))
    span = daily.groupBy("station").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("station", F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(daily, ["station", "date"], "left")


def match_window(passes: DataFrame, obs: DataFrame, pad_hours: int = 2) -> DataFrame:
    """Mean value of a site's observations strictly inside the padded pass, on the pass's date; 0 without any."""
    pad = F.expr(f"interval {pad_hours} hours")
    inside = (F.col("ts") > F.col("start_ts") - pad) & (F.col("ts") < F.col("end_ts") + pad)
    o = obs.select(F.col("station").alias("site"), F.to_date("ts").alias("date"), "ts", "value")
    hit = passes.join(o, ["site", "date"]).filter(inside).groupBy("pass_id").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return passes.join(hit, "pass_id", "left").select("pass_id", "site", F.coalesce("v", F.lit(0.0)).alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def knn_idw(points: DataFrame, stations: DataFrame, m: int = 10, block: int = 8192, own: Column | None = None) -> DataFrame:
    """id, ps, ps_dist for points (id, lon, lat): inverse-square mean of the m nearest stations (value) and the least distance.
    A station on the point gives its own value.  Ties by station id.  Points without a place get nulls, stations without one
    are left out.  ``own`` (of id) names a station that isn't a point's neighbour; a point without another one has no row.

    Places are points of the unit sphere, where chords grow with the distance; for how blocks of both sides meet see
    ``candidates``.  Of stations whose chords are equal but for rounding all are candidates, and the distance decides.
    """

    def placed(df: DataFrame, lon: str, lat: str, to: str) -> DataFrame:
        x, y = (F.radians(F.col(c).cast("double")) for c in (lon, lat))
        return df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn(to, F.array(F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)))

    # stations of one place are equally far from everything: the first of them by id stand for all, and points of one place look once
    keep = m if own is None else m + 1
    spots = points.select("lon", "lat").distinct().withColumn("spot", F.struct("lon", "lat"))
    rank = F.row_number().over(Window.partitionBy("slon", "slat").orderBy("station", "value"))
    first = stations.select("station", F.col("lon").alias("slon"), F.col("lat").alias("slat"), "value").withColumn("rank", rank).filter(F.col("rank") <= keep)
    places = first.groupBy("slon", "slat").agg(F.min("station").alias("least"), F.collect_list(F.struct("station", "value")).alias("here"))
    met = candidates(placed(spots, "lon", "lat", "x"), placed(places.drop("here"), "slon", "slat", "y"), keep, "spot", "least", block, slack=1e-6)
    d = met.join(places.drop("least"), ["slon", "slat"]).withColumn("d", haversine(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat")))
    each = F.transform("here", lambda e: F.struct(F.col("d").alias("d"), e["station"].alias("station"), e["value"].alias("value")))
    near = d.groupBy("spot").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, keep).alias("near"))
    g = points.select("id", "lon", "lat").join(near.select("spot.lon", "spot.lat", "near"), ["lon", "lat"])
    if own is not None:
        g = g.withColumn("self", own).withColumn("near", F.expr("slice(filter(near, e -> not (e.station <=> self)), 1, {})".format(m))).filter(F.size("near") > 0)
    on = F.expr("near[0].d = 0")
    num = F.expr("aggregate(near, 0D, (a, e) -> a + e.value / (e.d * e.d))")
    den = F.expr("aggregate(near, 0D, (a, e) -> a + 1 / (e.d * e.d))")
    out = g.select("id", F.when(on, F.expr("near[0].value")).otherwise(num / den).alias("ps"), F.expr("near[0].d").alias("ps_dist"))
    lost = points.filter("lon is null or lat is null").select("id", F.lit(None).cast("double").alias("ps"), F.lit(None).cast("double").alias("ps_dist"))
    return out.union(lost)


# grids
def daily_cell_mean(cells: DataFrame, zone: str) -> DataFrame:
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    return cells.groupBy(F.to_date(local).alias("date"), "lat", "lon").agg(F.avg("value").alias("value"))


def grid_transform(cells: DataFrame) -> DataFrame:
    """t0..t5, n_rows, n_cols of the regular grid whose cell middles are the distinct lon and lat of ``cells``: steps are the
    range over the number of gaps, the corner lies half a step outside.  One row or column has a step of null."""
    a = cells.agg(F.min("lon").alias("x"), F.max("lat").alias("y"), (F.max("lon") - F.min("lon")).alias("dx"), (F.max("lat") - F.min("lat")).alias("dy"), F.countDistinct("lon").alias("n_cols"), F.countDistinct("lat").alias("n_rows"))
    w, h = F.try_divide(F.col("dx"), F.col("n_cols") - 1), F.try_divide(F.col("dy"), F.col("n_rows") - 1)
    zero = F.lit(0.0)
    return a.select((F.col("x") - w / 2).alias("t0"), w.alias("t1"), zero.alias("t2"), (F.col("y") + h / 2).alias("t3"), zero.alias("t4"), (-h).alias("t5"), "n_rows", "n_cols")


def composite(df: DataFrame, key: list[str], value: str, control: int) -> DataFrame:
    """Mean of positive values; null outside (0.01, 1) or with fewer than ``control`` of them."""
    x = F.when(F.col(value) > 0, F.col(value))
    g = df.groupBy(*key).agg(F.avg(x).alias("m"), F.count(x).alias("n"))
    ok = (F.col("m") > 0.01) & (F.col("m") < 1.0) & (F.col("n") >= control)
    return g.select(*key, F.when(ok, F.col("m")).alias("value"), "n")


def climatology_anomaly(target: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """Value above the mean of all images of the key; missing anywhere, or below, gives 0."""
    mean = F.when(F.count("value") == F.count("*"), F.sum("value") / F.count("*"))
    h = history.groupBy(*key).agg(mean.alias("mean"))
    return target.join(h, key, "left").withColumn("anomaly", F.greatest(F.lit(0.0), F.coalesce(F.col("value") - F.col("mean"), F.lit(0.0))))


def zonal_counts(pixels: DataFrame, key: list[str], value: str, other: str, ranges: list[tuple[float, float]]) -> DataFrame:
    """Of each group the number of values in each half-open range (lo, hi] as n1, n2, ..., and 100 times the mean of the non-zero
    values of ``other`` (0 without any)."""
    counts = [F.count_if((F.col(value) > lo) & (F.col(value) <= hi)).alias(f"n{i + 1}") for i, (lo, hi) in enumerate(ranges)]
    mean = F.coalesce(F.try_divide(F.sum(other), F.count_if(F.col(other) != 0)), F.lit(0.0)) * 100
    return pixels.groupBy(*key).agg(*counts, mean.alias("mean100"))


def segment_shape(pixels: DataFrame, key: list[str]) -> DataFrame:
    """area, extent, major and minor axis by second central moments, from sums only."""
    g = pixels.groupBy(*key).agg(F.count("*").alias("area"), F.var_pop("r").alias("rr"), F.var_pop("c").alias("cc"), F.covar_pop("r", "c").alias("rc"), ((F.max("r") - F.min("r") + 1) * (F.max("c") - F.min("c") + 1)).alias("box"))
    mid, off = (F.col("rr") + F.col("cc")) / 2, F.sqrt(F.pow((F.col("rr") - F.col("cc")) / 2, 2) + F.pow("rc", 2))
    return g.select(*key, "area", (F.col("area") / F.col("box")).alias("extent"), (4 * F.sqrt(mid + off)).alias("major"), (4 * F.sqrt(F.greatest(F.lit(0.0), mid - off))).alias("minor"))


def _beside(value: str, at: str, other: str) -> tuple[Column, Column]:
    """``value`` of the cells before and behind along ``at``; null where that cell is absent."""
    w = Window.partitionBy("scene", other).orderBy(at)
    return tuple(F.when(f(at).over(w) == F.col(at) + d, f(value).over(w)) for f, d in ((F.lag, -1), (F.lead, 1)))


def eddy(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Value less the mean of its four neighbours (the cell itself stands for one that is null, absent or beyond the edge), never
    below 0; missing gives 0."""
    near = [F.coalesce(x, F.col(value)) for at, other in ("cr", "rc") for x in _beside(value, at, other)]
    return pixels.withColumn("eddy", F.greatest(F.lit(0.0), F.coalesce(F.col(value) - reduce(lambda a, b: a + b, near) / 4, F.lit(0.0))))


def haar_approx(pixels: DataFrame, level: int, value: str = "v") -> DataFrame:
    """Low-pass blocks of 2**level cells a side: sum / 2**level.  At each level an odd last row or column counts twice, as if it
    stood once more behind the edge."""
    size = pixels.groupBy("scene").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))

    def weight(at: Column, n: Column) -> Column:
        w = F.lit(1)
        for _ in range(level):
            w = w * F.when((n % 2 == 1) & (at == n - 1), 2).otherwise(1)
            at, n = F.floor(at / 2), F.floor((n + 1) / 2)
        return w

    w = weight(F.col("r"), F.col("rows")) * weight(F.col("c"), F.col("cols"))
    n = 1 << level
    return pixels.join(size, "scene").groupBy("scene", F.expr(f"r div {n}").alias("r"), F.expr(f"c div {n}").alias("c")).agg((F.sum(F.col(value) * w) / n).alias("v"))


def boundary(segments: DataFrame) -> DataFrame:
    """True where the cell differs from its right or lower neighbour; a cell that is absent differs from none."""
    right, low = (_beside("segment", at, other)[1] for at, other in ("cr", "rc"))
    differs = F.coalesce(right != F.col("segment"), F.lit(False)) | F.coalesce(low != F.col("segment"), F.lit(False))
    return segments.withColumn("edge", differs)


def raster_diff(a: DataFrame, b: DataFrame, dr: int = 0, dc: int = 0) -> DataFrame:
    """a - b over the common cells, with b shifted by whole cells."""
    b = b.select((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), F.col("v").alias("w"))
    return a.join(b, ["r", "c"]).select("r", "c", (F.col("v") - F.col("w")).alias("diff"))


def scene_diff(pairs: DataFrame, scenes: DataFrame, pixels: DataFrame) -> DataFrame:
    """a - b over the true intersection of two scenes: (pair, r, c, lon, lat, diff), r and c counted from the intersection's corner,
    lon and lat that of the cell's outer corner.

    ``pairs``: pair, a, b (scenes); ``scenes``: scene, t0, t1, t3, t5 (origin and steps, of any sign), n_rows, n_cols;
    ``pixels``: scene, r, c, v.  b is moved by the whole number of cells that is nearest to the offset of its origin.  Pairs whose
    steps differ have no common grid, and pairs that don't meet no common cell: neither gives rows."""

    def side(x: str) -> DataFrame:
        return scenes.select(F.col("scene").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("t0", "t1", "t3", "t5", "n_rows", "n_cols")])

    p = pairs.join(side("a"), "a").join(side("b"), "b")
    same = [F.abs(F.col(f"a_{t}") - F.col(f"b_{t}")) <= 1e-9 * F.abs(F.col(f"a_{t}")) for t in ("t1", "t5")]
    dr, dc = F.round((F.col("b_t3") - F.col("a_t3")) / F.col("a_t5")).cast("int"), F.round((F.col("b_t0") - F.col("a_t0")) / F.col("a_t1")).cast("int")
    p = p.filter(same[0] & same[1]).withColumns({"dr": dr, "dc": dc})
    zero = F.lit(0)
    p = p.withColumns({"r0": F.greatest(zero, "dr"), "c0": F.greatest(zero, "dc"), "r1": F.least(F.col("a_n_rows"), F.col("b_n_rows") + F.col("dr")), "c1": F.least(F.col("a_n_cols"), F.col("b_n_cols") + F.col("dc"))})
    p = p.filter("r0 < r1 and c0 < c1")
    inside = (F.col("r") >= F.col("r0")) & (F.col("r") < F.col("r1")) & (F.col("c") >= F.col("c0")) & (F.col("c") < F.col("c1"))
    left = p.join(pixels.withColumnRenamed("scene", "a"), "a").filter(inside).select("pair", "r", "c", "v", "r0", "c0", (F.col("a_t0") + F.col("c") * F.col("a_t1")).alias("lon"), (F.col("a_t3") + F.col("r") * F.col("a_t5")).alias("lat"))
    right = p.join(pixels.select(F.col("scene").alias("b"), "r", "c", F.col("v").alias("w")), "b").select("pair", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "w")
    return left.join(right, ["pair", "r", "c"]).select("pair", (F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), "lon", "lat", (F.col("v") - F.col("w")).alias("diff"))


def texture(counts: DataFrame, levels: int, k: int) -> DataFrame:
    """Nine texture values of each cell; empty level pairs enter entropy and deviation in closed form."""
    n, d, cells, base = F.col("n"), F.col("i") - F.col("j"), levels * levels, 1.0 / (k * k)
    p = n / (k * k) + base
    g = counts.groupBy("scene", "r", "c").agg(
        F.max("n").alias("max"), F.sum(-p * F.log(p)).alias("e"), F.count("*").alias("nz"), (F.sum(n * F.col("i")) / cells).alias("mean"), F.sum(F.pow(n * F.col("i"), 2)).alias("sq"),
        F.sum(n * d * d).cast("double").alias("contrast"), F.sum(n * F.abs(d)).cast("double").alias("dissimilarity"), F.sum(n / (1 + d * d)).alias("homogeneity"), F.sum(n * n).cast("double").alias("asm"),
    )
    import math

    entropy = F.col("e") + (cells - F.col("nz")) * (-base * math.log(base))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - cells * F.col("mean") * F.col("mean")))
    return g.select("scene", "r", "c", "max", entropy.alias("entropy"), "mean", std.alias("std"), "contrast", "dissimilarity", "homogeneity", "asm", F.sqrt("asm").alias("energy"))


def cover(polygons: DataFrame, bucket: float = 1.0) -> DataFrame:
    """Polygons (id, ring array<struct<x,y>>, and more columns) as buckets: bx, by, whole, edges and the other columns.

    A bucket that no edge touches lies wholly inside (``whole``, without edges) or isn't there.  Others hold the edges of their
    band of rows that reach their left side or what is right of it: those that a ray to the right can meet.  So a ring
    is never copied: it is split by bands, whatever its length."""
    others = [c for c in polygons.columns if c != "ring"]
    poly = polygons.withColumn("__p", F.sha2(F.to_json(F.struct(*polygons.columns)), 256))
    ends = poly.dropDuplicates(["__p"]).select("__p", F.posexplode("ring").alias("i", "a"), "ring").select("__p", "a", F.expr("ring[(i + 1) % size(ring)]").alias("b"))
    edge = F.struct(F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
    low, high = (f(F.col("a.y"), F.col("b.y")) for f in (F.least, F.greatest))
    bands = ends.select("__p", edge.alias("e"), F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket))).alias("by"))

    def across(y: Column) -> Column:
        """x of an edge at height y, no further than its ends."""
        t = F.coalesce(F.try_divide(y - F.col("e.y1"), F.col("e.y2") - F.col("e.y1")), F.lit(0.0))
        return F.col("e.x1") + F.least(F.lit(1.0), F.greatest(F.lit(0.0), t)) * (F.col("e.x2") - F.col("e.x1"))

    level = F.col("e.y1") == F.col("e.y2")
    at = [F.when(level, x).otherwise(across(y)) for x, y in ((F.col("e.x1"), F.col("by") * bucket), (F.col("e.x2"), (F.col("by") + 1) * bucket))]
    slack = 1e-9 * bucket
    touched = bands.select("__p", "by", F.explode(F.sequence(F.floor((F.least(*at) - slack) / bucket), F.floor((F.greatest(*at) + slack) / bucket))).alias("bx")).distinct()
    rows = bands.groupBy("__p", "by").agg(F.collect_list("e").alias("band"), F.min(F.least("e.x1", "e.x2")).alias("west"), F.max(F.greatest("e.x1", "e.x2")).alias("east"))
    cells = rows.select("__p", "by", "band", F.explode(F.sequence(F.floor((F.col("west") - slack) / bucket), F.floor((F.col("east") + slack) / bucket))).alias("bx"))
    cells = cells.join(touched.withColumn("edge", F.lit(True)), ["__p", "by", "bx"], "left")
    middle = _crossings("band", f"(bx + 0.5D) * {bucket}D", f"(by + 0.5D) * {bucket}D")
    reach = F.expr(f"filter(band, e -> greatest(e.x1, e.x2) >= bx * {bucket}D)")
    found = cells.withColumns({"whole": F.col("edge").isNull(), "edges": F.when(F.col("edge"), reach)}).filter(F.col("edge") | (middle % 2 == 1))
    return found.select("__p", "bx", "by", "whole", "edges").join(poly.select("__p", *others), "__p").drop("__p")


def _crossings(edges: str, x: str, y: str) -> Column:
    """How many edges a ray from (x, y) to the right meets."""
    return F.expr(f"size(filter({edges}, e -> ((e.y1 > {y}) <> (e.y2 > {y})) and {x} < (e.x2 - e.x1) * try_divide({y} - e.y1, e.y2 - e.y1) + e.x1))")


def clip(points: DataFrame, polygons: DataFrame, bucket: float = 1.0) -> DataFrame:
    """Points (lon, lat) inside polygons (id, ring array<struct<x,y>>) by the even-odd rule.  Buckets of the polygons' ``cover``
    meet points by equality; only those that an edge touches need rays.  Null places and rings match nothing."""
    p = points.withColumns({"bx": F.floor(F.col("lon") / bucket), "by": F.floor(F.col("lat") / bucket)})
    met = p.join(cover(polygons, bucket), ["bx", "by"])
    return met.filter(F.col("whole") | (_crossings("edges", "lon", "lat") % 2 == 1)).drop("bx", "by", "whole", "edges")


def purity(points: DataFrame, classes: DataFrame, half: int = 3, least: float = 0.75) -> DataFrame:
    """Share of the commonest class in the window about each point (id, r, c), and whether it exceeds ``least``."""
    span = F.sequence(F.lit(-half), F.lit(half))
    w = points.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span)).select("id", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    g = w.join(classes, ["r", "c"]).groupBy("id", "class").count().groupBy("id").agg((F.max("count") / F.sum("count")).alias("share"))
    return g.withColumn("pure", F.col("share") > least)


# features
def fold(key: Column, k: int) -> Column:
    """Reproducible fold 0..k-1 of an integer key."""
    return ((key * 48271) % 2147483647) % k


def max_normalise(df: DataFrame, columns: list[str], codes: tuple[str, ...] = ()) -> DataFrame:
    """Columns over their maxima; ``codes`` (class numbers) are rounded first."""
    df = df.withColumns({c: F.round(c) for c in codes}) if codes else df
    top = F.broadcast(df.agg(*[F.max(c).alias(f"__{c}") for c in columns]))
    return df.join(top).withColumns({c: F.try_divide(F.col(c), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])


def min_max(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Scaled by the minimum and maximum of the training rows; a constant column gives 0, a null value stays null."""
    m = df.filter(train).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(F.broadcast(m))
    return out.withColumns({c: F.when(F.col(f"__hi_{c}") == F.col(f"__lo_{c}"), F.when(F.col(c).isNotNull(), 0.0)).otherwise(F.try_divide(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))) for c in columns}).drop(*m.columns)


def standardise(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Less the training mean, over the training population deviation (1 where that is 0)."""
    m = df.filter(train).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(m))
    return out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}).drop(*m.columns)


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """fold (null: all), n, mse, r2."""
    e = F.pow(F.col(y) - F.col(p), 2)
    return df.rollup("fold").agg(F.count("*").alias("n"), F.avg(e).alias("mse"), (1 - F.try_divide(F.avg(e), F.var_pop(y))).alias("r2"))


def best_checkpoint(log: DataFrame, start_row: int) -> DataFrame:
    """Of each fold the epoch of the best val_r2 after ``start_row``; the first of equals."""
    w = Window.partitionBy("fold").orderBy(F.desc("val_r2"), "epoch")
    return log.filter(F.col("epoch") > start_row).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def epochs(log: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of a training log whose epoch lies between ``start`` and ``end``, both included."""
    return log.filter(F.col("epoch").between(start, end))


def tail(log: DataFrame, start_row: int) -> DataFrame:
    """Of each fold the rows from place ``start_row`` (from 0) on, in order of the epoch."""
    w = Window.partitionBy("fold").orderBy("epoch")
    return log.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") > start_row).drop("__n")


def select_features(df: DataFrame, features: list[str], target: str, *keys: str) -> DataFrame:
    """Keys, feature columns in this order and the target, all numbers as doubles."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in (*features, target)])


# reports
def grouped_report(df: DataFrame, sets: list[tuple[str, ...]], value: str = "value") -> DataFrame:
    """n and the mean of ``value`` for each grouping set, with ``grouping`` (the bits of the columns that a row sums over), so that a
    total and a null key aren't mistaken for each other."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.grouping_id().cast("long").alias("grouping"), F.count("*").alias("n"), F.avg(value).alias("value"))


def distinct_sketches(df: DataFrame, keys: list[str], item: Column, bits: int = 14) -> DataFrame:
    """A mergeable sketch of the distinct values of ``item`` for each key: keys, sketch.  Null items don't count."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(item, bits).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated distinct values of coarser keys (none: of all), from finer sketches alone."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
