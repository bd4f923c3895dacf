"""Per-user behaviour and the wide feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import share


def session_features(sessions: DataFrame) -> DataFrame:
    """Sessions, durations and rates of each user; the checkout rate is 0 without carts and may exceed 1."""
    carts, bought = F.count_if("has_cart"), F.count_if("has_purchase")
    return sessions.groupBy("user_id").agg(
        F.count("user_session").alias("total_sessions"), F.avg("duration_sec").alias("avg_session_duration"), F.coalesce(F.stddev("duration_sec"), F.lit(0.0)).alias("std_session_duration"),
        F.avg("event_count").alias("avg_events_per_session"), share(carts, F.count("user_session")).alias("cart_rate"), F.coalesce(share(bought, carts), F.lit(0.0)).alias("checkout_rate"),
    )


# fixed values: what a user without purchases or sessions has
_RFM = {"recency_days": -1, "frequency_count": 0, "monetary_value": 0.0, "segment_name": "Browser", "rfm_code": "000"}
_NAMES = {"frequency_count": "frequency_raw", "monetary_value": "monetary_raw", "segment_name": "rfm_segment"}


def feature_table(users: DataFrame, rfm: DataFrame, behaviour: DataFrame) -> DataFrame:
    """One row per user: profile, segment and behaviour. All three are keyed by user_id, so one partitioning serves both joins."""
    joined = users.join(rfm.select("user_id", *_RFM), "user_id", "left").join(behaviour, "user_id", "left")
    return joined.select(
        "user_id", "total_spend", "purchase_count", "event_count", "first_seen", "last_seen",
        *(F.coalesce(F.col(c), F.lit(v)).alias(_NAMES.get(c, c)) for c, v in _RFM.items()),
        F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"),
        *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("avg_session_duration", "std_session_duration", "avg_events_per_session", "cart_rate", "checkout_rate")),
    )
