"""The star schema as a set of views, and SQL over it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from larkspur.operators import affinity, features, retention, rfm, star


def build_star(events: DataFrame, variant: str = "f", min_support: int = 5, as_of: str | None = None) -> dict[str, DataFrame]:
    """The derived tables by name, as plans: nothing runs until one is used or written."""
    users = star.dim_users(events, variant)
    segments = rfm.rfm_segments(rfm.rfm_base(events, variant, as_of), variant)
    out = {
        "dim_products": star.dim_products(events, drop_null_key=variant == "c"),
        "dim_users": users,
        "fact_daily_kpis": star.daily_kpis(events, variant),
        "fact_sessions": star.sessions(events) if variant == "f" else star.compact_sessions(events),
        "analysis_rfm_segments" if variant == "f" else "user_rfm_segments": segments,
        "predictions_product_affinity": affinity.affinity_rules(events, min_support, variant),
    }
    if variant == "f":
        out["features_users"] = features.feature_table(users, segments, features.session_features(out["fact_sessions"]))
        out["analysis_weekly_retention"] = retention.weekly_retention(events, users)
        out["analysis_churn_risk"] = retention.churn_status(users, events, as_of)
    return out


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_query(spark: SparkSession, sql: str, **args: Any) -> DataFrame:
    """SQL over the registered views; values go in as parameters (:name), never as text."""
    return spark.sql(sql, args=args)
