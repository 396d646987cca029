"""Windowed counts of events, for tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hourly(events: DataFrame, users: Column) -> DataFrame:
    grouped = events.where("ts is not null").groupBy(F.window("ts", "1 hour"), "event_type")
    total = (F.floor(F.sum("value") * 1e3 + 0.5) / 1e3).alias("total")
    return grouped.agg(F.count("*").alias("events"), users.alias("users"), total).select(F.col("window.start").alias("window_start"), "event_type", "events", "users", "total")


def hourly(events: DataFrame) -> DataFrame:
    """(window_start, event_type, events, users, total) of each hour of a table; rows without a time are left out."""
    return _hourly(events, F.countDistinct("user_id"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, began, events) of each run of a user's events with gaps under ``gap``."""
    rows = events.where("ts is not null and user_id is not null")
    grouped = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return grouped.select("user_id", F.col("session_window.start").alias("began"), "events")


def hourly_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The windows of ``hourly`` for a stream; events later than ``late`` are dropped with their window's state.

    ``users`` is HyperLogLog's estimate (5 % deviation), since a stream's state can't hold every user of a window.
    """
    return _hourly(events.withWatermark("ts", late), F.approx_count_distinct("user_id"))


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that has arrived, written as parquet; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
