"""Streams over the event table and the override log. The original system has none: these are additions.

Each stream gives what the same batch query gives once its input has been read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int = 100) -> DataFrame:
    """Events as a stream; ts becomes a zoned timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tumbling days by type: (day, event_type, n, value); events later than the delay are dropped."""
    windowed = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.to_date("window.start").alias("day"), "event_type", "n", "value")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Read what is there, write each batch's result over the last one (complete) or behind it (append), and stop."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
