"""Windows, sessions and duplicates over streams; the same code runs on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """New Parquet files of a folder as a stream of the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 8).parquet(folder)


def tumbling(df: DataFrame, time: str, by: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and sums a window and key; rows later than ``late`` are left out of a stream."""
    stamped = df.withColumn(time, F.col(time).cast("timestamp")) if df.isStreaming else df
    marked = stamped.withWatermark(time, late) if df.isStreaming else stamped
    out = marked.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "events", F.bround("total", 4).alias("total"))


def sliding(df: DataFrame, time: str, by: list[str], width: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    stamped = df.withColumn(time, F.col(time).cast("timestamp")) if df.isStreaming else df
    marked = stamped.withWatermark(time, late) if df.isStreaming else stamped
    return marked.groupBy(F.window(time, width, step).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *by, "events")


def sessions(df: DataFrame, time: str, by: list[str], gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of rows of a key with no gap of ``gap`` or more."""
    stamped = df.withColumn(time, F.col(time).cast("timestamp")) if df.isStreaming else df
    marked = stamped.withWatermark(time, late) if df.isStreaming else stamped
    out = marked.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("events"))
    return out.select(*by, F.col("w.start").alias("start"), "events")


def deduplicated(df: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; a stream remembers keys for ``late``."""
    if df.isStreaming:
        return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)
