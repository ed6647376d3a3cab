"""Latency metrics of the query profile as a stream: tumbling windows, late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_profile(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(profile: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", mode: str = "event_type", latency: str = "value") -> DataFrame:
    """window_start, mode, n, avg_latency, max_latency; works on a stream and on a table."""
    src = profile.withWatermark(time, late) if profile.isStreaming else profile
    out = src.groupBy(F.window(time, window).alias("w"), F.col(mode).alias("mode")).agg(F.count("*").alias("n"), F.avg(latency).alias("avg_latency"), F.max(latency).alias("max_latency"))
    return out.select(F.col("w.start").alias("window_start"), "mode", "n", F.round("avg_latency", 6).alias("avg_latency"), "max_latency")


def run_once(metrics: DataFrame, path: str, checkpoint: str) -> None:
    """Process what there is and stop; exactly once per window thanks to the checkpoint."""
    metrics.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
