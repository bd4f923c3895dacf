"""Column functions that Spark lacks or counts differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.sources.schema import PURCHASE


def is_type(kind: str) -> Column:
    return F.col("event_type") == kind


def count_type(kind: str) -> Column:
    return F.count_if(is_type(kind))


def revenue() -> Column:
    """Sum of the purchases' prices, 0 without any."""
    return F.sum(F.when(is_type(PURCHASE), F.col("price")).otherwise(F.lit(0.0))).cast("double")


def day(column: str = "event_time") -> Column:
    return F.to_date(column)


def week(column: str = "event_time") -> Column:
    """Monday of the week, without a zone."""
    return F.date_trunc("week", F.col(column)).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Second boundaries crossed."""
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def rounded_seconds(start: Column, end: Column) -> Column:
    """Elapsed time to the nearest second."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.round(micros / F.lit(1e6)).cast("long")


def hash_order(seed: int | str, *columns: str) -> Column:
    """A number below 2**52, told by the columns' text and the seed alone; any engine that knows MD5 gives the same."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def share(part: Column, whole: Column) -> Column:
    """Quotient of doubles, null where the denominator is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def to_tenth(x: Column) -> Column:
    """A double to one decimal place by its exact binary value, ties to even, as C and Python print it; %.1f here rounds its decimal text half up.

    A product of doubles falls on the right side of a tie or on the tie itself. There 8x, 2x and both differences are exact.
    """
    tens = x * 10
    error = (8 * x - tens) + 2 * x
    tie = (F.abs(tens - F.rint(tens)) == 0.5) & (error != 0)
    return F.when(tie, tens + F.signum(error) / 2).otherwise(F.rint(tens)) / 10


def format_compact(column: str) -> Column:
    """1234567 as 1.2M."""
    x = F.col(column).cast("double")
    steps = [(1e9, "B"), (1e6, "M"), (1e3, "K")]
    out = F.format_string("%.0f", F.rint(x))
    for size, unit in reversed(steps):
        out = F.when(F.abs(x) >= size, F.format_string(f"%.1f{unit}", to_tenth(x / size))).otherwise(out)
    return F.when(x.isNotNull(), out)


def format_usd(column: str) -> Column:
    """1234.5 as $1,234.50."""
    return F.concat(F.lit("$"), F.format_number(F.col(column).cast("double"), 2))
