"""The driver's tables as event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.dealing import ROWS, dealt


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` with brand and category of `part`; a session is a user's day."""
    e, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "part"))
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "click", "cart").when(F.col("event_type") == "error", "remove_from_cart").when(F.col("event_type") == "signup", "other").otherwise(F.col("event_type"))
    e = e.select(F.col("ts").alias("event_time"), kind.alias("event_type"), k.alias("product_id"), F.col("value").alias("price"), "user_id")
    p = p.select(F.col("p_partkey").alias("k"), F.col("p_type").alias("category_code"), F.col("p_brand").alias("brand"))
    return e.join(p, F.col("product_id") == F.col("k"), "left").select(
        "event_time", "event_type", "product_id", F.lit(None).cast("long").alias("category_id"), "category_code", "brand", "price", "user_id",
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("event_time", "yyyyMMdd")).alias("user_session"),
    )


def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a purchase; a session is an order.

    Lines and orders are dealt to as many tasks as the lines take, which their files' footers tell; log.tasks holds it.
    """
    li, o, p = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    tasks = 1 + li.count() // ROWS
    li, o = dealt(li, tasks, "l_orderkey"), dealt(o, tasks, "o_orderkey")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    log = joined.select(
        F.col("o_orderdate").alias("event_time"), F.lit("purchase").alias("event_type"), F.col("l_partkey").alias("product_id"), F.lit(None).cast("long").alias("category_id"),
        F.col("p_type").alias("category_code"), F.col("p_brand").alias("brand"), F.col("l_extendedprice").alias("price"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").cast("string").alias("user_session"),
    )
    log.tasks = tasks
    return log
