"""Recency, frequency and monetary segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import day, hash_order, is_type
from larkspur.plans.ranking import ntiles
from larkspur.sources.schema import PURCHASE


def latest(df: DataFrame) -> DataFrame:
    """One row: the newest event time, as as_of."""
    return df.agg(F.max("event_time").alias("as_of"))


def with_as_of(df: DataFrame, events: DataFrame, as_of: str | None) -> DataFrame:
    """Adds as_of: the date given, or that of the newest event; no value goes through the driver."""
    return df.withColumn("as_of", F.to_date(F.lit(as_of))) if as_of else df.crossJoin(F.broadcast(latest(events)))


def rfm_base(df: DataFrame, variant: str = "f", as_of: str | None = None) -> DataFrame:
    """Buyers only. Frequency counts purchase rows (F) or purchase days (C)."""
    frequency, names = (F.count("*"), ("frequency_count", "monetary_value")) if variant == "f" else (F.count_distinct(day()), ("frequency", "monetary"))
    users = df.filter(is_type(PURCHASE)).groupBy("user_id").agg(F.max("event_time").alias("last"), frequency.alias(names[0]), F.sum("price").cast("double").alias(names[1]))
    return with_as_of(users, df, as_of).select("user_id", F.date_diff("as_of", "last").alias("recency_days"), *names)


def _labels(rules: tuple, otherwise: str) -> Column:
    """The first rule that holds; a rule is the bounds of R and of F and a label."""
    out = None
    for (r_lo, r_hi), (f_lo, f_hi), label in rules:
        hold = F.col("r_score").between(r_lo, r_hi) & F.col("f_score").between(f_lo, f_hi)
        out = F.when(hold, label) if out is None else out.when(hold, label)
    return out.otherwise(otherwise)


# fixed values: bounds of R and F scores, label
RULES_F = (
    ((4, 5), (4, 5), "Champions"),
    ((3, 5), (3, 5), "Loyal Customers"),
    ((4, 5), (1, 1), "New Customers"),
    ((3, 5), (1, 1), "Promising"),
    ((2, 2), (2, 5), "Need Attention"),
    ((1, 1), (4, 5), "Cant Lose Them"),
    ((1, 1), (1, 2), "Hibernating"),
)
RULES_C = (
    ((4, 5), (4, 5), "Champions"),
    ((3, 5), (3, 5), "Loyal Customers"),
    ((4, 5), (1, 2), "Promising"),
    ((1, 2), (3, 5), "At Risk"),
    ((1, 2), (1, 2), "Lost"),
)


def rfm_segments(base: DataFrame, variant: str = "f") -> DataFrame:
    """Quintile scores, their code or total, and a label. Ties in a measure go by user_id. Exact at any size, see ntiles()."""
    if variant == "f":
        scored = ntiles(base, {"r": ["recency_days", "user_id"], "f_score": ["frequency_count", "user_id"], "m_score": ["monetary_value", "user_id"]}, 5, "user_id")
        scored = scored.withColumn("r_score", 6 - F.col("r")).drop("r")
        code = F.concat(*(F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")))
        return scored.select(*base.columns, "r_score", "f_score", "m_score", code.alias("rfm_code"), _labels(RULES_F, "At Risk").alias("segment_name"))
    scored = ntiles(base, {"r_score": ["-recency_days", "user_id"], "f_score": ["frequency", "user_id"], "m_score": ["monetary", "user_id"]}, 5, "user_id")
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    return scored.select(*base.columns, "r_score", "f_score", "m_score", total.alias("rfm_total"), _labels(RULES_C, "Regular").alias("segment"))


def segment_profile(rfm: DataFrame) -> DataFrame:
    """Users, mean spend and recency, and share of the buyers by segment."""
    by = rfm.groupBy("segment_name").agg(F.count("*").alias("user_count"), F.round(F.avg("monetary_value"), 2).alias("avg_spend"), F.round(F.avg("recency_days"), 1).alias("avg_recency"))
    return by.withColumn("pct", F.round(100.0 * F.col("user_count") / F.sum("user_count").over(Window.partitionBy()), 2))


def segment_coverage(features: DataFrame) -> DataFrame:
    return features.groupBy("rfm_segment").agg(F.count("*").alias("users")).orderBy(F.desc("users"), "rfm_segment")


def rfm_scatter_sample(rfm: DataFrame, n: int = 10_000, seed: int = 7) -> DataFrame:
    """Exactly n rows (or all), the same ones each time."""
    return rfm.withColumn("rfm_code", F.concat(*(F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")))).orderBy(hash_order(seed, "user_id"), "user_id").limit(n)
