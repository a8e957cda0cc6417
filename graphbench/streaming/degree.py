"""An extension beyond batch graphs: degrees of a stream of events by tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degree(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, element_id, degree of users' events in windows; late events beyond the watermark are dropped by Spark."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("User:"), F.col("user_id").cast("string")).alias("element_id"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "element_id").agg(F.count("*").alias("degree")).select(F.col("w.start").alias("start"), "element_id", "degree")
