"""From layers on grids of their own to predictions on one target grid: points, alignment, gaps, masks and samples."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import geo_to_index, pixel_to_geo, wind_direction, wind_speed

Transform = tuple[float, float, float, float, float, float]


# points and grids
def in_bounds(row: Column, col: Column, n_rows: Column | int, n_cols: Column | int) -> Column:
    """Whether a (fractional) index lies inside a raster: 0 <= index < size on both axes."""
    return (row >= 0) & (row < n_rows) & (col >= 0) & (col < n_cols)


def points_in_scenes(scenes: DataFrame, stations: DataFrame, bucket: float = 1.0) -> DataFrame:
    """station, scene, r, c: the cell of each station in each scene that holds it.

    ``scenes``: scene, t0..t5, n_rows, n_cols; ``stations``: station, lon, lat.  Scenes meet stations on buckets of their
    bounding boxes, so no station is paired with a scene far away.  Stations without a place match nothing.
    """
    t = tuple(F.col(f"t{i}") for i in range(6))
    corners = [pixel_to_geo(t, r, c) for r in (F.lit(0), F.col("n_rows")) for c in (F.lit(0), F.col("n_cols"))]

    def span(k: int) -> Column:
        ends = [x[k] for x in corners]
        return F.explode(F.sequence(F.floor(F.least(*ends) / bucket), F.floor(F.greatest(*ends) / bucket)))

    boxes = scenes.withColumn("bx", span(0)).withColumn("by", span(1))
    at = stations.select("station", "lon", "lat", F.floor(F.col("lon") / bucket).alias("bx"), F.floor(F.col("lat") / bucket).alias("by"))
    row, col = geo_to_index(t, F.col("lon"), F.col("lat"))
    met = at.join(boxes, ["bx", "by"]).filter(in_bounds(row, col, F.col("n_rows"), F.col("n_cols")))
    return met.select("station", "scene", row.cast("int").alias("r"), col.cast("int").alias("c"))


def extract_at_points(pixels: DataFrame, scenes: DataFrame, stations: DataFrame, bucket: float = 1.0) -> DataFrame:
    """station and all columns of ``pixels`` for each scene that holds the station and has a cell there (see ``points_in_scenes``)."""
    return points_in_scenes(scenes, stations, bucket).join(pixels, ["scene", "r", "c"])


@dataclass(frozen=True)
class Layer:
    """Cells (``keys``, r, c, v) on the grid of ``transform``.  Without keys the layer is the same for all rows."""

    cells: DataFrame
    transform: Transform
    keys: tuple[str, ...] = ("date",)


def align_layers(target: DataFrame, transform: Transform, layers: dict[str, Layer]) -> DataFrame:
    """``target`` (r, c and the layers' keys) with a column for each layer: its value in the cell that holds the middle of the
    target's, null outside its grid.

    Layers of one grid and key become one wide table first, so the target is joined once for each grid, not for each layer.
    """
    lon, lat = pixel_to_geo(transform, F.col("r") + 0.5, F.col("c") + 0.5)
    grids: dict[tuple[Transform, tuple[str, ...]], list[str]] = {}
    for name, layer in layers.items():
        grids.setdefault((layer.transform, layer.keys), []).append(name)
    out = target
    for (t, keys), names in grids.items():
        long = reduce(DataFrame.unionByName, [layers[n].cells.select(*keys, F.col("r").alias("__r"), F.col("c").alias("__c"), F.col("v").cast("double").alias("v"), F.lit(n).alias("layer")) for n in names])
        wide = long.groupBy(*keys, "__r", "__c").agg(*[F.max(F.when(F.col("layer") == n, F.col("v"))).alias(n) for n in names])
        row, col = geo_to_index(t, lon, lat)
        out = out.withColumns({"__r": F.floor(row).cast("int"), "__c": F.floor(col).cast("int")}).join(wide, [*keys, "__r", "__c"], "left").drop("__r", "__c")
    return out


def stack_layers(layers: dict[str, DataFrame], monthly: tuple[str, ...] = ()) -> DataFrame:
    """(date, r, c) and a column for each of ``layers`` (date, r, c, v), over the cells that all have: index-aligned, so cropped
    to the least height and width.  Layers named in ``monthly`` have one image a month and serve all of its days."""
    daily = [n for n in layers if n not in monthly]
    long = reduce(DataFrame.unionByName, [layers[n].select("date", "r", "c", "v", F.lit(n).alias("layer")) for n in daily])
    held = reduce(lambda a, b: a & b, [F.max(F.col("layer") == n) for n in daily])
    out = long.groupBy("date", "r", "c").agg(*[F.max(F.when(F.col("layer") == n, F.col("v"))).alias(n) for n in daily], held.alias("__all")).filter("__all").drop("__all")
    for n in monthly:
        month = layers[n].select(F.trunc("date", "month").alias("__month"), "r", "c", F.col("v").alias(n))
        out = out.withColumn("__month", F.trunc("date", "month")).join(month, ["__month", "r", "c"]).drop("__month")
    return out


def merge_datasets(datasets: dict[str, DataFrame]) -> DataFrame:
    """(r, c) and a column for each dataset (r, c, v): all cells that any has, in one exchange."""
    long = reduce(DataFrame.unionByName, [d.select("r", "c", "v", F.lit(n).alias("dataset")) for n, d in datasets.items()])
    return long.groupBy("r", "c").agg(*[F.max(F.when(F.col("dataset") == n, F.col("v"))).alias(n) for n in datasets])


# predictions
def predict_present(df: DataFrame, features: list[str], score: Callable[[DataFrame], DataFrame], name: str = "prediction") -> DataFrame:
    """All rows of ``df`` with ``name``: what ``score`` adds to rows that have every feature, null for the others, which the
    model never sees.  No shuffle."""
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features])
    known = score(df.filter(whole)).select(*df.columns, F.col(name).cast("double").alias(name))
    return known.unionByName(df.filter(~whole).withColumn(name, F.lit(None).cast("double")))


def mask_result(prediction: Column, band: Column, nodata: float = 0.0) -> Column:
    """0 where ``band`` has its nodata value."""
    return F.when(band == nodata, 0.0).otherwise(prediction)


def class_samples(classes: dict[int, DataFrame]) -> DataFrame:
    """Samples of all classes in one table, with their label; a class may lack columns of the others (null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("label", F.lit(k)) for k, d in classes.items()])


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """n and the share of rows whose prediction is the label (null: wrong), over all or for each ``by``."""
    right = F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("double")
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


# wind
def pair_components(cells: DataFrame, u: str, v: str) -> DataFrame:
    """(ts, lat, lon, u, v) where both variables have a value at one time and place: one aggregation, no join."""
    one = [F.max(F.when(F.col("variable") == name, F.col("value"))).alias(to) for name, to in ((u, "u"), (v, "v"))]
    return cells.filter(F.col("variable").isin(u, v)).groupBy("ts", "lat", "lon").agg(*one).filter("u is not null and v is not null")


def morning_wind(pairs: DataFrame, zone: str, first: str = "08:30:00", last: str = "12:30:00") -> DataFrame:
    """(date, lat, lon, speed, direction): daily means of pairs (ts, lat, lon, u, v) whose local time lies in the overpass window,
    both ends included.  Directions are averaged as numbers."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    near = pairs.withColumn("local", local).filter(F.date_format("local", "HH:mm:ss").between(first, last))
    means = [F.avg(f(F.col("u"), F.col("v"))).alias(n) for n, f in (("speed", wind_speed), ("direction", wind_direction))]
    return near.groupBy(F.to_date("local").alias("date"), "lat", "lon").agg(*means)


# segments
def zonal_statistics(df: DataFrame, key: list[str], columns: dict[str, Column]) -> DataFrame:
    """Mean, population deviation, maximum and minimum of each of ``columns`` in each group; nulls don't count."""
    stats = (("mean", F.avg), ("std", F.stddev_pop), ("max", F.max), ("min", F.min))
    return df.withColumns(columns).groupBy(*key).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in stats])


def _hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of integer points (monotone chain)."""
    points = np.unique(points, axis=0)

    def half(order: np.ndarray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for x, y in order.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    ring = np.array(half(points) + half(points[::-1]))
    x, y = ring[:, 0], ring[:, 1]
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def convex_area(pixels: DataFrame) -> DataFrame:
    """(scene, segment, convex_area) of the corners of each segment's cells (so never less than its cells).  Only the first and
    last cell of each row reach the group."""
    ends = pixels.groupBy("scene", "segment", F.col("r").cast("long").alias("r")).agg(F.min("c").cast("long").alias("lo"), F.max("c").cast("long").alias("hi"))
    kind = ", ".join(f"`{c}` {ends.schema[c].dataType.simpleString()}" for c in ("scene", "segment"))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        r, lo, hi = (rows[c].to_numpy() for c in ("r", "lo", "hi"))
        points = np.concatenate([np.stack([a, b], 1) for a in (r, r + 1) for b in (lo, hi + 1)])
        return pa.table({"scene": pa.array([key[0].as_py()], rows.schema.field("scene").type), "segment": pa.array([key[1].as_py()], rows.schema.field("segment").type), "convex_area": [_hull_area(points)]})

    return ends.groupBy("scene", "segment").applyInArrow(run, f"{kind}, convex_area double")
