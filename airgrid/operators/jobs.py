"""Whole jobs of several operators: station truth and pixels to a table for training, hourly readings to a daily map, two scenes to areas of change."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import geo_to_index, pixel_to_geo
from . import grid as g
from . import prediction as p
from . import regions as x
from .lineage import cut


def training_table(readings: DataFrame, stations: DataFrame, pixels: DataFrame, scenes: DataFrame, days: DataFrame, bands: list[str], min_rows: int = 21, m: int = 10, folds: int = 10, unseen: int = 0) -> DataFrame:
    """station, date, scene, fold, y, ``bands``, ps and ps_dist: one row for each station's complete day and scene of that day.

    ``readings`` (station, ts, value, event_id) above 0, the first of each station and time, become daily means ``y`` of days with
    ``min_rows`` at least.  ``days`` (date, scene) says which scenes belong to a day; bands are those of the station's cell, so stations
    outside a scene or on an absent cell have no row.  ps is the inverse-square mean, at the cell's middle, of the mean values of the m
    nearest *other* stations, ps_dist the least distance in km (null without another one).  A station is in one fold, whole.
    Features are scaled by minimum and maximum of the stations outside fold ``unseen``; null bands stay null.
    """
    first = g.first_per_key(readings.filter("value > 0").select("station", "ts", "value", "event_id"), ["station", "ts"], ["event_id"])
    truth = g.daily_station_mean(first, min_rows).select("station", "date", F.col("value").alias("y"))
    means = first.groupBy("station").agg(F.avg("value").alias("value"))
    at = cut(p.extract_at_points(pixels.select("scene", "r", "c", *bands), scenes, stations))
    t = tuple(F.col(f"t{i}") for i in range(6))
    lon, lat = pixel_to_geo(t, F.col("r") + 0.5, F.col("c") + 0.5)
    # one place for each station and scene; the place's own station is left out of its neighbours
    places = at.join(scenes, "scene").select(F.struct("station", "scene").alias("id"), lon.alias("lon"), lat.alias("lat"))
    known = stations.join(means, "station").select("station", "lon", "lat", "value")
    near = g.knn_idw(places, known, m, own=F.col("id.station")).select("id.station", "id.scene", "ps", "ps_dist")
    table = truth.join(days, "date").join(at.select("station", "scene", *bands), ["station", "scene"]).join(near, ["station", "scene"], "left")
    table = cut(table.withColumn("fold", g.fold(F.col("station"), folds)))
    scaled = g.min_max(table, [*bands, "ps", "ps_dist"], F.col("fold") != unseen)
    return scaled.select("station", "date", "scene", "fold", "y", *bands, "ps", "ps_dist")


def gridded(df: DataFrame, transform: p.Transform, value: str, *keys: str) -> DataFrame:
    """(keys, r, c, v): mean ``value`` of the places (lon, lat) in each cell of a grid.  Null places are left out."""
    row, col = geo_to_index(transform, F.col("lon"), F.col("lat"))
    cells = df.filter("lon is not null and lat is not null").select(*keys, F.floor(row).cast("int").alias("r"), F.floor(col).cast("int").alias("c"), F.col(value).alias("v"))
    return cells.groupBy(*keys, "r", "c").agg(F.avg("v").alias("v"))


def daily_map(values: DataFrame, winds: DataFrame, transform: p.Transform, coarse: p.Transform, static: dict[str, p.Layer], score: Callable[[DataFrame], DataFrame], zone: str, floor: float = 0.0) -> DataFrame:
    """(date, r, c, value, prediction) for each day and cell of a grid that has values.

    ``values`` (ts, lon, lat, value) become daily means of a cell by local date, less ``floor`` and never below 0.  ``winds`` (ts, lat,
    lon, u, v) become the morning's speed and direction on the ``coarse`` grid; ``static`` layers have no date.  All are laid on
    the grid of ``transform`` and divided by their maxima.  ``score`` adds prediction to cells that have every layer; it is null
    for the others, and 0 where the value is 0 or less.  A null value (a cell with null readings only) has a prediction still.
    """
    means = gridded(g.daily_cell_mean(values, zone), transform, "value", "date")
    target = means.select("date", "r", "c", F.when(F.col("v").isNotNull(), F.greatest(F.col("v") - floor, F.lit(0.0))).alias("value"))
    wind = p.morning_wind(winds, zone)
    layers = {n: p.Layer(gridded(wind, coarse, n, "date"), coarse, ("date",)) for n in ("speed", "direction")} | static
    aligned = g.max_normalise(p.align_layers(target, transform, layers), list(layers))
    got = p.predict_present(aligned, list(layers), score)
    return got.select("date", "r", "c", "value", p.mask_result(F.col("prediction"), F.col("value")).alias("prediction"))


def segment_classes(pixels: DataFrame, classify: Callable[[str], Column], step: int, compactness: float = 10.0, iterations: int = 10) -> DataFrame:
    """(scene, r, c, class): each cell gets its superpixel's class, ``classify`` of the superpixel's mean (rounded to 9 digits); cells
    without a value belong to none and get 0."""
    segments = cut(x.superpixels(pixels, step, compactness, iterations))
    stats = p.zonal_statistics(segments, ["scene", "sr", "sc"], {"v": F.col("v")})
    classes = stats.select("scene", "sr", "sc", classify(F.round("v_mean", 9)).alias("class"))
    painted = segments.join(classes, ["scene", "sr", "sc"]).select("scene", "r", "c", "class")
    missing = pixels.filter("v is null").select("scene", "r", "c", F.lit(0).alias("class"))
    return painted.unionByName(missing)


def change_areas(classes: DataFrame, pairs: DataFrame, scenes: DataFrame, change: int, unit_area: float = 1.0) -> DataFrame:
    """(pair, r, c, cells, area) of each 4-connected area whose class differs by ``change`` between the scenes of a pair.

    ``classes``: scene, r, c, class; ``pairs`` and ``scenes`` as in ``scene_diff``, so only cells of the true intersection count, and r
    and c (the area's first cell, by row and column) are counted from its corner."""
    diff = g.scene_diff(pairs, scenes, classes.select("scene", "r", "c", F.col("class").alias("v")))
    changed = diff.filter(F.col("diff") == change).select(F.col("pair").alias("scene"), "r", "c")
    areas = x.connected_areas(changed, unit_area)
    return areas.select(F.col("scene").alias("pair"), F.col("label.r").alias("r"), F.col("label.c").alias("c"), "cells", "area")
