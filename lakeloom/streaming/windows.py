"""Event-time windows over a stream or a table. An addition: batch buckets are the nearest thing elsewhere in the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamped(events: DataFrame, column: str = "ts") -> DataFrame:
    """Times as timestamps with a zone, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def source(spark: SparkSession, path: str, schema, per_trigger: int = 16) -> DataFrame:
    """Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",), value: str = "value", slide: str | None = None) -> DataFrame:
    """Count and sum by window and keys; windows slide with ``slide``."""
    at = F.window("ts", every, slide) if slide else F.window("ts", every)
    out = stamped(events).withWatermark("ts", late).groupBy(at.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Events of a key that follow each other within the gap, as one row."""
    out = stamped(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    frame = stamped(events).withWatermark("ts", late)
    return frame.dropDuplicatesWithinWatermark(keys) if frame.isStreaming else frame.dropDuplicates(keys)
