"""The event log's columns and event types."""

from pyspark.sql import types as T

# fixed values: event types of the log
VIEW, CART, REMOVE, PURCHASE = "view", "cart", "remove_from_cart", "purchase"

#: Raw CSV: event_time is text such as `2019-10-01 00:00:00 UTC`.
RAW = T.StructType(
    [
        T.StructField("event_time", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
)
RAW_TIME = "yyyy-MM-dd HH:mm:ss 'UTC'"
COLUMNS = RAW.fieldNames()
