"""How many tasks a step takes, told from counted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task takes: a larger table has more tasks, not larger ones.
ROWS = 250_000


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt by the keys to so many tasks; to those that Spark chooses where it has as many cores."""
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df
