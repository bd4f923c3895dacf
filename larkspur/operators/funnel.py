"""Funnels over sessions and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import count_type, is_type, share
from larkspur.plans.ranking import with_median
from larkspur.sources.schema import CART, PURCHASE, VIEW


def session_funnel(sessions: DataFrame) -> DataFrame:
    """Sessions that reach each stage, and rates to 4 places; the overall rate is over all sessions."""
    stages = [F.count_if(F.col(f"has_{s}")).alias(f"sessions_with_{s}") for s in (VIEW, CART, PURCHASE)]
    view, cart, buy = (F.col(f"sessions_with_{s}") for s in (VIEW, CART, PURCHASE))
    return sessions.agg(*stages, F.count("*").alias("n")).select(
        view, cart, buy, F.round(share(cart, view), 4).alias("view_to_cart_rate"), F.round(share(buy, cart), 4).alias("cart_to_purchase_rate"), F.round(share(buy, F.col("n")), 4).alias("overall_conversion"),
    )


def session_stats(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("sessions"), F.avg("duration_sec").alias("avg_duration_sec"))


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(100 * share(part, whole), F.lit(0.0))


def event_funnel(df: DataFrame) -> DataFrame:
    """Events of each stage and rates in per cent, 0 where there is nothing to divide by."""
    counts = df.agg(*(count_type(s).alias(f"{s}s") for s in (VIEW, CART, PURCHASE)))
    view, cart, buy = F.col("views"), F.col("carts"), F.col("purchases")
    return counts.select(
        view, cart, buy, F.round(_pct(cart, view), 4).alias("view_to_cart_pct"), F.round(_pct(buy, cart), 4).alias("cart_to_purchase_pct"), F.round(_pct(buy, view), 4).alias("view_to_purchase_pct"),
        F.round(F.when(cart > 0, 100 - _pct(buy, cart)).otherwise(0.0), 4).alias("cart_abandonment_pct"),
    )


def distinct_session_funnel(df: DataFrame) -> DataFrame:
    """Distinct sessions with an event of each stage: sessions are reduced to flags first, so no row is expanded."""
    by = df.filter("user_session IS NOT NULL").groupBy("user_session").agg(*(F.bool_or(is_type(s)).alias(s) for s in (VIEW, CART, PURCHASE)))
    return by.agg(*(F.count_if(F.col(s)).alias(f"{s}_sessions") for s in (VIEW, CART, PURCHASE)))


def session_characteristics(sessions: DataFrame) -> DataFrame:
    bought = 100.0 * F.avg(F.col("has_purchase").cast("int"))
    totals = sessions.agg(F.avg("duration_sec").alias("avg_duration"), F.avg("event_count").alias("avg_events"), bought.alias("purchase_session_pct"))
    return with_median(sessions, "duration_sec", "median_duration", totals)


def session_conversion(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.avg(F.col("has_purchase").cast("int")).alias("conversion"))
