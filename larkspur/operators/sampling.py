"""Samples of users and how they compare with the whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import day, hash_order
from larkspur.plans.ranking import ntiles

_GRAIN = 1_000_000


def hashed_share(share: float, seed: int, *columns: str) -> Column:
    """True for about this share of the rows, the same ones each time."""
    return hash_order(seed, *columns) % _GRAIN < int(share * _GRAIN)


def thin_rows(df: DataFrame, keep: float = 0.5, seed: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """About `keep` of the rows, told by the columns `by`, or by all."""
    return df.filter(hashed_share(keep, seed, *(by or df.columns)))


def first_share(users: DataFrame, stratum: str, part: float, seed: int) -> DataFrame:
    """user_id and stratum of the first ceil(part * n) of each stratum's n users, in a seeded order.

    A user's place is told from hash buckets: only users in the bucket that holds the limit are put in order, and
    whole buckets before it are taken. There are 1024 buckets a stratum, and strata are few.
    """
    order = hash_order(seed, "user_id")
    users = users.select("user_id", stratum, order.alias("order"), F.shiftrightunsigned(order, 42).cast("int").alias("bucket"))
    counts = users.groupBy(stratum, "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(stratum).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limits = counts.select(stratum, "bucket", (F.ceil(F.sum("n").over(Window.partitionBy(stratum)) * part) - before).alias("room"), "n")
    held = users.join(F.broadcast(limits.filter("room > 0")), [stratum, "bucket"])
    place = F.row_number().over(Window.partitionBy(stratum, "bucket").orderBy("order", "user_id"))
    whole, cut = held.filter("room >= n"), held.filter("room < n").withColumn("place", place).filter("place <= room")
    return whole.select("user_id", stratum).unionByName(cut.select("user_id", stratum))


def stratified_users(df: DataFrame, pct: float = 3.0, seed: int = 5) -> DataFrame:
    """user_id, quintile: of each quintile of users by activity the first pct per cent in a seeded order."""
    users = ntiles(df.groupBy("user_id").agg(F.count("*").alias("events")), {"quintile": ["events", "user_id"]}, 5, "user_id")
    return first_share(users, "quintile", pct / 100, seed)


def stratified_user_sample(df: DataFrame, pct: float = 3.0, keep: float = 0.5, seed: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """About `keep` of the events of a stratified sample of users."""
    return thin_rows(df.join(stratified_users(df, pct, seed), "user_id", "left_semi").select(df.columns), keep, seed, by)


def compare_mix(original: DataFrame, sample: DataFrame) -> DataFrame:
    """Events and their share by type, in the original and the sample."""

    def mix(df: DataFrame, name: str) -> DataFrame:
        by = df.groupBy("event_type").agg(F.count("*").alias("count"))
        return by.select(F.lit(name).alias("dataset"), "event_type", "count", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy()), 2).alias("pct"))

    return mix(original, "Original").unionByName(mix(sample, "Sample"))


def temporal_coverage(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct(day()).alias("days"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))
