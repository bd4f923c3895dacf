"""The star schema: products, users, sessions and days. Variant F is the full model, C the compact one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import count_type, day, is_type, revenue, rounded_seconds, seconds_between
from larkspur.plans.dealing import dealt
from larkspur.sources.schema import CART, PURCHASE, REMOVE, VIEW


def dim_products(df: DataFrame, drop_null_key: bool = False) -> DataFrame:
    """The newest row of each product; ties go to the highest price, then category, then brand, then category id. No window.

    Spark sorts for this aggregate. Where the log tells how many tasks its rows take, they are dealt to so many: first by
    product and hash of the row, so that a frequent product spreads too, then what is left by product.
    """
    tasks = vars(df).get("tasks", 0)
    df = df.filter("product_id IS NOT NULL") if drop_null_key else df
    rows = df.select("product_id", F.struct("event_time", "price", "category_code", "brand", "category_id").alias("r"))
    if tasks > df.sparkSession.sparkContext.defaultParallelism:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("r.event_time", "r.price"), F.lit(tasks)))
        rows = dealt(dealt(rows, tasks, "product_id", "part").groupBy("product_id", "part").agg(F.max("r").alias("r")), tasks, "product_id")
    return rows.groupBy("product_id").agg(F.max("r").alias("r")).select(
        "product_id", "r.category_id", F.coalesce("r.category_code", F.lit("unknown")).alias("category_code"), F.coalesce("r.brand", F.lit("unknown")).alias("brand"), F.col("r.price").alias("current_price"),
    )


# fixed values: column names of the two variants for events, views, carts and purchases of a day
_DAY_NAMES = {"f": ("total_events", "total_views", "total_carts", "total_purchases"), "c": ("daily_events", "views", "carts", "purchases")}


def daily_kpis(df: DataFrame, variant: str = "f") -> DataFrame:
    events, views, carts, purchases = _DAY_NAMES[variant]
    return df.groupBy(day().alias("date")).agg(
        F.count("*").alias(events), F.count_distinct("user_id").alias("dau"), F.count_distinct("user_session").alias("daily_sessions"), revenue().alias("daily_revenue"),
        count_type(PURCHASE).alias(purchases), count_type(CART).alias(carts), count_type(VIEW).alias(views),
    )


def dim_users(df: DataFrame, variant: str = "f") -> DataFrame:
    buyer = F.bool_or(is_type(PURCHASE))
    extra = (
        [buyer.alias("is_buyer"), F.max(F.when(is_type(VIEW), F.col("category_code"))).alias("favorite_category_by_recency")]
        if variant == "f"
        else [buyer.cast("int").alias("is_buyer")]
    )
    return df.groupBy("user_id").agg(
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.count("*").alias("event_count"), F.count_distinct("user_session").alias("session_count"),
        revenue().alias("total_spend"), count_type(PURCHASE).alias("purchase_count"), *extra,
    )


def favorite_category(df: DataFrame) -> DataFrame:
    """The category that each user viewed last."""
    return df.filter(is_type(VIEW)).groupBy("user_id").agg(F.max_by("category_code", F.struct("event_time", "category_code")).alias("last_viewed_category"))


def sessions(df: DataFrame) -> DataFrame:
    """One row per session id: span, funnel stages, revenue, most frequent category (the smallest of tied ones)."""
    return df.filter("user_session IS NOT NULL").groupBy("user_session").agg(
        F.max("user_id").alias("user_id"), F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"),
        seconds_between(F.min("event_time"), F.max("event_time")).alias("duration_sec"), F.count("*").alias("event_count"),
        F.bool_or(is_type(VIEW)).alias("has_view"), F.bool_or(is_type(CART)).alias("has_cart"), F.bool_or(is_type(REMOVE)).alias("has_remove"), F.bool_or(is_type(PURCHASE)).alias("has_purchase"),
        revenue().alias("session_revenue"), F.mode("category_code", True).alias("top_category"),
    )


def compact_sessions(df: DataFrame) -> DataFrame:
    """One row per session id and user, null sessions included."""
    return df.groupBy("user_session", "user_id").agg(
        F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"), rounded_seconds(F.min("event_time"), F.max("event_time")).alias("duration_sec"),
        F.count("*").alias("event_count"), F.count_distinct("product_id").alias("unique_products"), F.bool_or(is_type(PURCHASE)).cast("int").alias("has_purchase"), revenue().alias("session_revenue"),
    )
