"""Continuous forms of the batch operators, on Structured Streaming.

The engine's scope is batch; these run the same aggregates over files that keep
arriving, with event time, a watermark and exactly-once file sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as they arrive."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], every: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows by key and window of event time; rows later than the watermark are left out."""
    at = F.col(time).cast(T.TimestampType())
    span = F.window("__at", every, slide) if slide else F.window("__at", every)
    return (
        events.withColumn("__at", at).withWatermark("__at", late).groupBy(span, *keys).agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")
    )


def append_parquet(df: DataFrame, folder: str, checkpoint: str):
    """Starts a query that takes all files there are and writes closed windows once."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
