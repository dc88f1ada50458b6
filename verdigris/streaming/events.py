"""Windowed counts of events, on a batch or on a stream. An extension: the same function serves both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; late sets a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest_stream(chunks: DataFrame, late: str = "1 day") -> DataFrame:
    """New chunks once each, by id, within the watermark. Needs ts and chunk_id."""
    return chunks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["chunk_id"])
