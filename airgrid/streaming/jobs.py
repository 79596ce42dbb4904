"""Streaming twins of the station products; event time is a timestamp with a watermark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(stream: DataFrame, min_rows: int = 21, late: str = "1 day") -> DataFrame:
    """Daily station means with the completeness gate, emitted when the day is past the watermark."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = s.groupBy("station", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return g.filter(F.col("n") >= min_rows).select("station", F.to_date("w.start").alias("date"), "n", "value")


def deduplicate(stream: DataFrame, late: str = "1 day") -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["station", "ts"])


def match_passes(passes: DataFrame, obs: DataFrame, pad: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Pairs of passes (pass_id, site, pass_ts) and observations of the site strictly within ``pad``."""
    p = passes.withColumn("pass_ts", F.col("pass_ts").cast("timestamp")).withWatermark("pass_ts", late)
    o = obs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    near = (p.site == o.station) & (o.ts > p.pass_ts - F.expr(f"interval {pad}")) & (o.ts < p.pass_ts + F.expr(f"interval {pad}"))
    return p.join(o, near).select("pass_id", "site", "pass_ts", "ts", "value")


def enrich(stream: DataFrame, stations: DataFrame) -> DataFrame:
    return stream.join(stations, "station")
