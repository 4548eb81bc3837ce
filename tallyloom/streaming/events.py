"""Structured Streaming over event tables: windows with watermarks, and duplicates across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_events(spark: SparkSession, path: str, pattern: str = "events.parquet") -> DataFrame:
    """Events of a folder as a stream; event time becomes a timestamp in UTC."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    t = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    return t.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum of values for each window and event type."""
    t = events.withWatermark("ts", late) if events.isStreaming else events
    t = t.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return t.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; as a stream, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_to_table(stream: DataFrame, checkpoint: str, target: str) -> None:
    """Drains a stream into a Parquet table; a restart goes on from the checkpoint."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").trigger(availableNow=True).start(target)
    query.awaitTermination()
