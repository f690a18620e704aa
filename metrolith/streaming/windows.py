"""Event-time windows over streams. These extend the engine: its model is batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(folder)


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(stream: DataFrame, width: str, delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """event_type, start, n, total by tumbling (or sliding) windows; rows later than
    ``delay`` are dropped and state is bounded by it."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return _timed(stream, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def gap_sessions(stream: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n: sessions that end after ``gap`` without events."""
    return _timed(stream, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark's reach."""
    return _timed(stream, delay).dropDuplicatesWithinWatermark([key])


def drained(spark: SparkSession, result: DataFrame, checkpoint: str, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, exactly once, and read what it wrote."""
    q = result.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).parquet(path)
