"""Event streams: transformations that work on batches and on streams alike, and their streaming form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Characters of a message that are kept.
MESSAGE_LIMIT = 24_000


def with_event_time(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp"))


def unique(df: DataFrame, key: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """One row a key: on streams within the watermark, on batches over all rows."""
    if df.isStreaming:
        return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums in (sliding) windows; late rows beyond the watermark are left out on streams."""
    df = df.withWatermark(time, delay) if df.isStreaming else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(
        F.unix_micros("w.start").alias("window_start"), *keys, "events", "total"
    )


def sessions(df: DataFrame, time: str, gap: str, key: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    df = df.withWatermark(time, delay) if df.isStreaming else df
    return df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events")).select(
        key, F.unix_micros("w.start").alias("session_start"), "events"
    )


def replay(spark: SparkSession, folder: str, schema, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, name: str, mode: str = "append") -> StreamingQuery:
    """The backlog from the first file on, then whatever arrives: one query a subscriber.

    A failing sink ends its own query only. ``availableNow`` makes tests end.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    return (
        transform(stream).writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(sink).start()
    )
