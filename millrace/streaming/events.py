"""Structured Streaming over event tables: an extension; batch frames work the same way.

``df`` may be a batch or a streaming frame with an event time; state is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files, with the schema of those that are there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def timed(df: DataFrame, time: str, late: str) -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(df: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts, and sums of ``value``, in tumbling or sliding windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.round(F.sum(value), 4).alias("total")] if value else [])
    out = timed(df, time, late).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def sessions(df: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with no pause of ``gap`` between them."""
    out = timed(df, time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(df: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return timed(df, time, late).dropDuplicatesWithinWatermark(keys)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what is there and return it as a table; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
