"""Weekly cohorts and churn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scalars import week
from larkspur.operators.rfm import with_as_of


def weekly_retention(df: DataFrame, users: DataFrame) -> DataFrame:
    """Active users by cohort week and weeks since; events shrink to distinct user weeks before they meet the users."""
    active = df.select("user_id", week().alias("activity_week")).distinct()
    cohorts = users.select("user_id", week("first_seen").alias("cohort_week"))
    since = F.expr("datediff(activity_week, cohort_week) DIV 7").cast("long")
    counts = active.join(cohorts, "user_id").groupBy("cohort_week", since.alias("weeks_since_first")).agg(F.count("*").alias("active_users"))
    sizes = cohorts.groupBy("cohort_week").agg(F.count("*").alias("cohort_size"))
    joined = counts.join(sizes, "cohort_week")  # a row a week on either side
    return joined.select("cohort_week", "weeks_since_first", "cohort_size", "active_users", (F.col("active_users") / F.col("cohort_size")).alias("retention_rate"))


def retention_matrix(retention: DataFrame, weeks: Sequence[int] | None = None) -> DataFrame:
    """Cohorts by weeks since, to 3 places. All weeks that occur, for which Spark runs the aggregate once ahead to find them, or only those given."""
    return retention.groupBy("cohort_week").pivot("weeks_since_first", None if weeks is None else list(weeks)).agg(F.first(F.round("retention_rate", 3)))


def retention_curves(retention: DataFrame) -> DataFrame:
    """A row a cohort: cohort_week, cohort_size, and rates, a map of every week that occurs to its rate.

    The same cells as retention_matrix(), as data: no pass finds the weeks first, and the columns don't grow with the log.
    """
    cells = F.sort_array(F.collect_list(F.struct("weeks_since_first", "retention_rate")))  # a cohort has a cell a week at most
    return retention.groupBy("cohort_week").agg(F.first("cohort_size").alias("cohort_size"), F.map_from_entries(cells).alias("rates"))


def churn_status(users: DataFrame, events: DataFrame, as_of: str | None = None, at_risk: int = 7, churned: int = 14) -> DataFrame:
    idle = F.date_diff("as_of", "last_seen")
    status = F.when(idle > churned, "Churned").when(idle > at_risk, "At Risk").otherwise("Active")
    return with_as_of(users, events, as_of).select("user_id", "last_seen", idle.alias("days_inactive"), status.alias("status"))


def churn_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("users"))
