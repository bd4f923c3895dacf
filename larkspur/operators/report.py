"""Profiles, summaries and reports over the event log and the star."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalars import count_type, day, is_type, revenue, share
from larkspur.plans.ranking import percentiles, with_median
from larkspur.sources.schema import CART, PURCHASE, VIEW


def _pct(part: Column, whole: Column, places: int = 2) -> Column:
    return F.round(100 * share(part, whole), places)


def _stages() -> list[Column]:
    return [F.count("*").alias("total_events"), count_type(VIEW).alias("views"), count_type(CART).alias("carts"), count_type(PURCHASE).alias("purchases")]


def product_summary(df: DataFrame) -> DataFrame:
    """Events by stage and the oldest row's price, brand and category of each product (ties: the smallest)."""
    first = F.min_by(F.struct("price", "brand", "category_code"), F.struct("event_time", "price", "brand", "category_code"))
    return df.groupBy("product_id").agg(*_stages(), first.alias("r"), F.count_distinct("user_id").alias("unique_users")).select(
        "product_id", "total_events", "views", "carts", "purchases", "r.price", "r.brand", "r.category_code", "unique_users"
    )


def user_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(*_stages(), F.count_distinct("product_id").alias("unique_products"), revenue().alias("total_spent"))


def daily_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(day().alias("date"), "event_type").agg(F.count("*").alias("event_count"), F.count_distinct("user_id").alias("unique_users"), revenue().alias("revenue")).orderBy("date", "event_type")


def dataset_overview(df: DataFrame, approx: bool = False) -> DataFrame:
    """Counts and time range. Exact distinct counts expand each row five times; approx counts in one pass."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    names = {"user_id": "unique_users", "product_id": "unique_products", "user_session": "unique_sessions", "brand": "unique_brands", "category_code": "unique_categories"}
    return df.agg(F.count("*").alias("total_events"), *(distinct(c).alias(n) for c, n in names.items()), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))


def event_mix(df: DataFrame) -> DataFrame:
    by = df.groupBy("event_type").agg(F.count("*").alias("count"))
    return by.withColumn("pct", _pct(F.col("count"), F.sum("count").over(Window.partitionBy()))).orderBy(F.desc("count"), "event_type")


def daily_trend(df: DataFrame) -> DataFrame:
    return df.groupBy(day().alias("date")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("dau"), revenue().alias("revenue")).orderBy("date")


def daily_trend_stats(df: DataFrame) -> DataFrame:
    return daily_trend(df).agg(
        F.avg("events").alias("avg_events"), F.max("events").alias("peak_events"), F.avg("dau").alias("avg_dau"), F.max("dau").alias("peak_dau"), F.sum("revenue").alias("total_revenue"), F.max("revenue").alias("peak_revenue")
    )


# fixed values: percentiles of the price report
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def price_percentiles(df: DataFrame, approx: bool = False) -> DataFrame:
    """Positive prices. Exact percentiles count every distinct price; approx keeps a bounded sketch instead."""
    df = df.filter("price > 0")
    if approx:
        all_ = df.agg(F.percentile_approx("price", F.array(*map(F.lit, PERCENTILES))).alias("p"), F.min("price").alias("least"), F.max("price").alias("greatest"), F.avg("price").alias("mean"))
    else:
        all_ = percentiles(df, "price", PERCENTILES)
    return all_.select(F.col("least").alias("min_price"), *(F.col("p")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(PERCENTILES)), F.col("greatest").alias("max_price"), F.col("mean").alias("avg_price"))


# fixed values: upper bounds and names of the price bands
BANDS = ((10, "$0-10"), (50, "$10-50"), (100, "$50-100"), (500, "$100-500"), (1000, "$500-1K"), (None, "$1K+"))


def price_bands(df: DataFrame) -> DataFrame:
    rank, label = F.lit(len(BANDS)), F.lit(BANDS[-1][1])
    for i in reversed(range(len(BANDS) - 1)):
        below = F.col("price") < BANDS[i][0]
        rank, label = F.when(below, i + 1).otherwise(rank), F.when(below, BANDS[i][1]).otherwise(label)
    return df.filter("price > 0").groupBy(rank.alias("band_rank"), label.alias("price_band")).agg(F.count("*").alias("events"), count_type(PURCHASE).alias("purchases")).orderBy("band_rank")


def _top(df: DataFrame, column: str, n: int) -> DataFrame:
    by = df.groupBy(F.coalesce(column, F.lit("unknown")).alias(column))
    return by.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), count_type(PURCHASE).alias("purchases")).orderBy(F.desc("events"), column).limit(n)


def top_categories(df: DataFrame, n: int = 15) -> DataFrame:
    return _top(df, "category_code", n)


def top_brands(df: DataFrame, n: int = 15) -> DataFrame:
    return _top(df, "brand", n)


def category_performance(df: DataFrame, n: int = 15) -> DataFrame:
    by = df.filter("category_code IS NOT NULL").groupBy("category_code").agg(F.count("*").alias("total_events"), count_type(PURCHASE).alias("purchases"))
    return by.orderBy(F.desc("purchases"), "category_code").limit(n)


def brand_performance(summary: DataFrame, n: int = 15) -> DataFrame:
    by = summary.filter("brand IS NOT NULL").groupBy("brand").agg(F.count("*").alias("product_count"), F.sum("purchases").alias("total_purchases"), F.sum("views").alias("total_views"))
    return by.orderBy(F.desc("total_purchases"), "brand").limit(n)


def activity_histogram(users: DataFrame) -> DataFrame:
    return users.groupBy("event_count").agg(F.count("*").alias("users")).orderBy("event_count")


def user_stats(users: DataFrame) -> DataFrame:
    bought = F.count_if(F.col("purchase_count") > 0)
    totals = users.agg(
        F.count("*").alias("total_users"), F.avg("event_count").alias("avg_events"), F.max("event_count").alias("max_events"), bought.alias("buyers"), _pct(bought, F.count("*"), 4).alias("conversion_pct")
    )
    return with_median(users, "event_count", "median_events", totals)


def user_engagement(summary: DataFrame) -> DataFrame:
    means = [F.avg(c).alias(n) for c, n in (("views", "avg_views"), ("carts", "avg_carts"), ("purchases", "avg_purchases"), ("unique_products", "avg_unique_products"), ("total_spent", "avg_total_spent"))]
    totals = summary.agg(F.avg("total_events").alias("avg_events"), F.max("total_events").alias("max_events"), *means)
    return with_median(summary, "total_events", "median_events", totals)


# fixed values: purchases above which a user is in a tier
TIERS = ((10, "High Buyer (10+)"), (5, "Medium Buyer (5-10)"), (0, "Low Buyer (1-5)"))


def buyer_tiers(summary: DataFrame) -> DataFrame:
    tier = F.when(F.col("carts") > 0, "Cart User").otherwise("Browser Only")
    for above, name in reversed(TIERS):
        tier = F.when(F.col("purchases") > above, name).otherwise(tier)
    by = summary.groupBy(tier.alias("segment")).agg(F.count("*").alias("count"))
    return by.withColumn("pct", _pct(F.col("count"), F.sum("count").over(Window.partitionBy())))


def product_stats(summary: DataFrame) -> DataFrame:
    totals = summary.agg(
        F.avg("total_events").alias("avg_events"), F.avg("views").alias("avg_views"), F.avg("carts").alias("avg_carts"), F.avg("purchases").alias("avg_purchases"), F.avg("unique_users").alias("avg_unique_users"),
        F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        _pct(F.count_if(F.col("purchases") > 0), F.count("*"), 4).alias("sold_pct"),
    )
    return with_median(summary, "price", "median_price", totals)


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    return df.filter(is_type(VIEW)).groupBy("product_id").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "product_id").limit(n)


def daily_aggregates(summary: DataFrame) -> DataFrame:
    """Over days: means, busiest and slowest day, revenue. A user counts once for each event type of a day."""
    days = summary.groupBy("date").agg(F.sum("event_count").alias("events"), F.sum("unique_users").alias("users"), F.sum("revenue").alias("revenue"))
    return days.agg(
        F.avg("events").alias("avg_events"), F.avg("users").alias("avg_users"), F.avg("revenue").alias("avg_revenue"),
        F.max_by("date", F.struct("events", "date")).alias("busiest_day"), F.min_by("date", F.struct("events", "date")).alias("slowest_day"),
        F.sum("revenue").alias("total_revenue"), F.max_by("date", F.struct("revenue", "date")).alias("peak_revenue_day"), F.max("revenue").alias("peak_revenue"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    nulls = [x for c in ("category_code", "brand", "user_session") for x in (F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), _pct(F.count_if(F.col(c).isNull()), F.count("*"), 4).alias(f"{c}_null_pct"))]
    return df.agg(*nulls, _pct(F.count_if((F.col("price") == 0) | F.col("price").isNull()), F.count("*"), 4).alias("no_price_pct"))


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: type, rows, nulls and numeric range. All columns are measured in one aggregate."""
    aggs, rows = [F.count("*").alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        c, numeric = F.col(f"`{f.name}`"), isinstance(f.dataType, T.NumericType)
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        aggs += [g(c).cast("double").alias(f"{k}{i}") for k, g in (("lo", F.min), ("hi", F.max), ("mean", F.avg))] if numeric else []
        nothing = F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col("rows"), F.col(f"n{i}").alias("nulls"),
                *((F.col(f"{k}{i}") if numeric else nothing).alias(n) for k, n in (("lo", "min_value"), ("hi", "max_value"), ("mean", "mean_value"))),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def events_per_session(df: DataFrame) -> DataFrame:
    by = df.filter("user_session IS NOT NULL").groupBy("user_session").agg(F.count("*").alias("n"))
    return with_median(by, "n", "median_events", by.agg(F.avg("n").alias("avg_events"), F.max("n").alias("max_events")))


def key_metrics(summary: DataFrame) -> DataFrame:
    """Share of buyers, and the mean over buyers of spend per purchase."""
    bought = F.col("purchases") > 0
    return summary.agg(_pct(F.count_if(bought), F.count("*"), 4).alias("buyer_rate_pct"), F.avg(F.when(bought, F.col("total_spent") / F.col("purchases"))).alias("avg_order_value"))


def executive_kpis(kpis: DataFrame) -> DataFrame:
    """Revenue, orders and their ratio, from the compact variant's days."""
    return kpis.agg(F.sum("daily_revenue").alias("total_revenue"), F.sum("purchases").alias("total_orders")).withColumn("aov", share(F.col("total_revenue"), F.col("total_orders")))


def sanity_totals(kpis: DataFrame, users: DataFrame) -> DataFrame:
    return kpis.agg(F.sum("daily_revenue").alias("total_revenue")).crossJoin(F.broadcast(users.agg(F.count_if("is_buyer").alias("buyers"))))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rows of each table. While a table is written, DataFrame.observe() gives its count without this scan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
