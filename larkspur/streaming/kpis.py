"""Daily figures and sessions from an unbounded log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import count_type, revenue
from larkspur.sources.schema import CART, PURCHASE, VIEW


def stream_daily_kpis(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and revenue by day, closed when the watermark has passed; distinct users are a sketch, as state must be bounded."""
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", "1 day").alias("day")).agg(
        F.count("*").alias("total_events"), F.approx_count_distinct("user_id").alias("dau"), revenue().alias("daily_revenue"),
        count_type(PURCHASE).alias("total_purchases"), count_type(CART).alias("total_carts"), count_type(VIEW).alias("total_views"),
    ).select(F.to_date("day.start").alias("date"), "total_events", "dau", "daily_revenue", "total_purchases", "total_carts", "total_views")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions by inactivity, for logs without session ids."""
    by = events.withWatermark("event_time", late).groupBy("user_id", F.session_window("event_time", gap).alias("s"))
    return by.agg(F.count("*").alias("event_count"), revenue().alias("session_revenue")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "event_count", "session_revenue")
