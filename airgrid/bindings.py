"""Views of the driver's tables as stations, readings, pixels and tiles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, ts, variable, value, qc."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("station"), "ts", F.col("event_type").alias("variable"), "value", F.get_json_object("props", "$.k").cast("int").alias("qc"), "event_id")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, lon, lat."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("station")).distinct()
    return s.withColumns({"lon": 79 + (F.col("station") % 13) * F.lit(0.9), "lat": 25 + (F.col("station") % 7) * F.lit(0.85)})


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, r, c and bands b1..b4: one row for each cell, the mean of its observations."""
    p = table(spark, sf_dir, "lineitem")
    scene = F.year("l_shipdate").alias("scene")
    bands = (F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)
    p = p.select(scene, (F.col("l_partkey") % 100).cast("int").alias("r"), F.col("l_suppkey").cast("int").alias("c"), *[b.alias(f"b{i + 1}") for i, b in enumerate(bands)])
    return p.groupBy("scene", "r", "c").agg(*[F.avg(f"b{i}").alias(f"b{i}") for i in range(1, 5)])


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, r, c, v: 8 x 8 cells of each vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene"), F.posexplode("embedding").alias("p", "x"))
    return e.select("scene", F.expr("p div 8").cast("int").alias("r"), (F.col("p") % 8).alias("c"), F.col("x").cast("double").alias("v"))
