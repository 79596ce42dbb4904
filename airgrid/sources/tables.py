"""Readers of station, photometer, point and feed files; layer and table writers."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Encodings that Spark's own reader knows.
KNOWN = ("iso-8859-1", "us-ascii", "utf-8", "utf-16be", "utf-16le", "utf-16", "utf-32")


def read_station_csv(spark: SparkSession, path: str, schema: StructType, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; columns by position of ``schema``, so a byte order mark in the header does no harm.

    Other encodings in which commas, quotes and line ends are single ASCII bytes (GBK) are read byte by byte, and their
    string columns decoded in Arrow batches."""
    own = encoding.lower() in KNOWN
    df = spark.read.csv(path, header=True, schema=schema, encoding=encoding if own else "ISO-8859-1", enforceSchema=True)
    if own:
        return df

    @F.pandas_udf("string")
    def decoded(text: pd.Series) -> pd.Series:
        return text.map(lambda v: v.encode("latin-1").decode(encoding), na_action="ignore")

    return df.withColumns({f.name: decoded(f.name) for f in schema if f.dataType.simpleString() == "string"})


def read_photometer(spark: SparkSession, path: str, site: str) -> DataFrame:
    """site, date, time, aot_440, aot_675, angstrom: four preamble lines, a header, then rows; the date from the file's name."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    lines = text.select("name", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).filter("n > 4 and length(line) > 0")
    row = F.from_csv("line", "d string, time string, aot_440 double, aot_675 double, angstrom double")
    date = F.to_date(F.concat(F.lit("20"), F.substring("name", 1, 6)), "yyyyMMdd")
    return lines.select(F.lit(site).alias("site"), date.alias("date"), row.alias("r")).select("site", "date", "r.time", "r.aot_440", "r.aot_675", "r.angstrom")


def read_points_txt(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", header=True, schema="lat double, lon double")


def read_feed_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def explode_cube(cube: DataFrame) -> DataFrame:
    """(variable, hours, epoch, lats, lons, values[time][lat][lon]) to (variable, ts, lat, lon, value)."""
    t = cube.select("variable", "hours", "epoch", "lats", "lons", F.posexplode("values").alias("i", "plane"))
    t = t.select("variable", F.expr("timestampadd(HOUR, hours[i], epoch)").alias("ts"), "lats", "lons", F.posexplode("plane").alias("j", "line"))
    t = t.select("variable", "ts", F.expr("lats[j]").alias("lat"), "lons", F.posexplode("line").alias("k", "value"))
    return t.select("variable", "ts", "lat", F.expr("lons[k]").alias("lon"), "value")


def tile_to_pixels(tiles: DataFrame, width: int, data: str = "data", key: str = "scene") -> DataFrame:
    """(key, r, c, v) from tiles whose values stand in one array, row by row, ``width`` to a row.  Null tiles have no cells."""
    at = tiles.select(key, F.posexplode(data).alias("p", "v"))
    return at.select(key, F.expr(f"p div {width}").cast("int").alias("r"), (F.col("p") % width).alias("c"), F.col("v").cast("double").alias("v"))


def stack_bands(long: DataFrame, bands: list[str]) -> DataFrame:
    """(scene, r, c, band, v) to one column for each band."""
    return long.groupBy("scene", "r", "c").pivot("band", bands).agg(F.first("v"))


def pixels_to_tile(pixels: DataFrame, value: str = "v", side: int = 256) -> DataFrame:
    """(scene, tile_r, tile_c, data): tiles of at most ``side`` x ``side`` cells as rows of values in order, null where a cell is
    missing.  A row or column beyond a scene's last cell isn't there; no row holds more than one tile."""
    size = pixels.groupBy("scene").agg(F.max("r").alias("rows"), F.max("c").alias("cols"))
    grid = size.select("scene", F.explode(F.expr("sequence(0, rows)")).alias("r"), "cols").select("scene", "r", F.explode(F.expr("sequence(0, cols)")).alias("c"))
    tile = [F.expr(f"cast({x} div {side} as int)").alias(f"tile_{x}") for x in "rc"]
    line = grid.join(pixels.select("scene", "r", "c", value), ["scene", "r", "c"], "left").groupBy("scene", *tile, "r").agg(F.array_sort(F.collect_list(F.struct("c", value))).alias("x"))
    line = line.select("scene", "tile_r", "tile_c", "r", F.expr(f"transform(x, e -> e.{value})").alias("line"))
    return line.groupBy("scene", "tile_r", "tile_c").agg(F.expr("transform(array_sort(collect_list(struct(r, line))), e -> e.line)").alias("data"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """path, name, sensor (letters before the first eight digits, if any), date (these) and variable (what follows them)."""
    f = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    return f.select("path", "name", F.regexp_extract("name", r"^([A-Za-z][A-Za-z0-9]*?)_\d{8}", 1).alias("sensor"), F.to_date(F.regexp_extract("name", r"(\d{8})", 1), "yyyyMMdd").alias("date"), F.regexp_extract("name", r"\d{8}_([A-Za-z0-9]+)", 1).alias("variable"))


def first_of_day(files: DataFrame, days: DataFrame) -> DataFrame:
    """For each of ``days`` (date) the first file of a ``catalogue`` by name, for each variable; null for days without one."""
    first = files.groupBy("date", "variable").agg(F.min_by("path", "name").alias("path"), F.min("name").alias("name"))
    return days.join(first, "date", "left")


#: How layers of a type are stored: unsigned whole numbers in the least signed type that holds them.
STORED = {"byte": ("smallint", 255), "uint16": ("int", 65535), "float32": ("float", None)}


def write_layers(df: DataFrame, path: str, dtype: str = "float32") -> None:
    """One folder for each variable and date, cells in row order; ``dtype``: byte, uint16 (both clamped to their range) or float32.
    Nulls stay null."""
    kind, top = STORED[dtype]
    value = F.col("value") if top is None else F.when(F.col("value").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(top), F.col("value"))))
    out = df.withColumn("value", value.cast(kind)).repartition("variable", "date").sortWithinPartitions("variable", "date", "row", "col")
    out.write.mode("overwrite").partitionBy("variable", "date").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)
