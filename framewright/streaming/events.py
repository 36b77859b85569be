"""Event streams: frame ticks, debounced bursts, and the same as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_ticks(events: DataFrame) -> DataFrame:
    """(user_id, event_id, frame_no, delta): each user's events in order, numbered, with the seconds since the last."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    delta = (seconds - F.lag(seconds).over(order)) / 1e6
    return events.select("user_id", "event_id", F.row_number().over(order).alias("frame_no"), F.coalesce(delta, F.lit(0.0)).alias("delta"))


def debounced(events: DataFrame, quiet: str = "6 hours") -> DataFrame:
    """(user_id, first_ts, last_ts, n): one row for each burst that a quiet time ends."""
    bursts = events.groupBy("user_id", F.session_window("ts", quiet).alias("s"))
    return bursts.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).drop("s")


def debounced_stream(stream: DataFrame, quiet: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """The same on a stream with an event time ``ts``; a burst comes out once the watermark has passed its end."""
    return debounced(stream.withWatermark("ts", late), quiet)


def subscribe(stream: DataFrame, on_event, checkpoint: str):
    """Runs ``on_event(batch, batch_id)`` for each micro-batch of events: one run at a time, coalescing what has come."""
    return stream.writeStream.foreachBatch(on_event).option("checkpointLocation", checkpoint)
