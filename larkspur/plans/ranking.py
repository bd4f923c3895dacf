"""Rows at given ranks, tiles and exact percentiles, of which no single task has to sort all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.plans.staging import staged

#: Values that cut a measure's range, and the range of keys within one value, into cells.
PARTS = 256
#: Accuracy of the percentiles that are the cuts.
ACCURACY = 10_000


def _cuts(column: str) -> Column:
    return F.array_distinct(F.percentile_approx(column, F.array(*(F.lit(i / PARTS) for i in range(1, PARTS))), F.lit(ACCURACY)))


#: Cuts that are searched together: first every STEP-th, then those before the next of them.
STEP = 16


def _below(cuts: str, heads: str, value: str) -> Column:
    """How many of the sorted cuts are smaller than the value; heads are the last cuts of every STEP."""
    return F.expr(f"transform(array(size(filter({heads}, c -> c < {value}))), h -> {STEP} * h + size(filter(slice({cuts}, {STEP} * h + 1, {STEP}), c -> c < {value})))[0]")


def rows_at(rows: DataFrame, ranks: Column) -> DataFrame:
    """m, k, v, key: of each measure the rows at the ranks asked for, in order of value and key.

    rows: m (the measure), v (double), key (long), w (how many rows it stands for); ranks: 1-based, from `total`, the
    sum of w. Approximate percentiles cut the values into cells: one for each cut, cut further by keys, as many rows
    may share a value, and one between every two. The cells' sizes tell which of them holds a rank, and only the
    rows of those are put in order.
    """
    cuts = rows.groupBy("m").agg(_cuts("v").alias("cuts"), _cuts("key").alias("keys"), F.sum("w").alias("total"))  # one row a measure
    heads = [F.expr(f"filter({c}, (x, i) -> i % {STEP} = {STEP - 1})").alias(f"{c}_heads") for c in ("cuts", "keys")]
    split = rows.join(F.broadcast(cuts.select("m", "cuts", "keys", *heads)), "m").withColumn("below", _below("cuts", "cuts_heads", "v"))
    at_cut = F.coalesce(F.get("cuts", F.col("below")) == F.col("v"), F.lit(False))
    split = split.select("m", "v", "key", "w", (2 * F.col("below") + at_cut.cast("int")).alias("part"), F.when(at_cut, _below("keys", "keys_heads", "key")).otherwise(0).alias("sub"))
    sizes = split.groupBy("m", "part", "sub").agg(F.sum("w").alias("size"))
    # a cell for each pair of cuts at most
    upto = F.sum("size").over(Window.partitionBy("m").orderBy("part", "sub"))
    asked = sizes.withColumn("upto", upto).join(F.broadcast(cuts.select("m", F.posexplode(ranks).alias("k", "rank"))), "m")
    cells = asked.filter("rank <= upto AND rank > upto - size").select("m", "part", "sub", "k", (F.col("rank") - F.col("upto") + F.col("size")).alias("place"))
    order = Window.partitionBy("m", "part", "sub", "k").orderBy("v", "key").rowsBetween(Window.unboundedPreceding, 0)
    held = split.join(F.broadcast(cells), ["m", "part", "sub"]).withColumn("reached", F.sum("w").over(order))
    return held.filter("place <= reached AND place > reached - w").select("m", "k", "v", "key")


def ntiles(df: DataFrame, orders: dict[str, list[str]], tiles: int, key: str) -> DataFrame:
    """Adds an NTILE column for each order, as ntile() over a window without partitions gives it.

    An order is a numeric column, a minus before it for descending, and the key, a long. Values are compared as doubles, so
    whole numbers above 2**53 may tie; then the key decides, as it does between equal ones. The rows that begin the
    tiles are looked up for all orders at once, and every row is compared with them. df is written once and read back.
    """
    df = staged(df, "tiled")
    sign = {name: (-1 if order[0][0] == "-" else 1, order[0].lstrip("-")) for name, order in orders.items()}
    # nulls come first, or last in descending order
    value = {name: F.coalesce(s * F.col(f"`{c}`").cast("double"), F.lit(float("-inf") * s)) for name, (s, c) in sign.items()}
    measures = F.array(*(F.struct(F.lit(name).alias("m"), v.alias("v")) for name, v in value.items()))
    rows = df.select(F.inline(measures), F.col(key).cast("long").alias("key"), F.lit(1).cast("long").alias("w"))
    begins = F.transform(F.sequence(F.lit(1), F.lit(tiles - 1)), lambda k: k * F.floor(F.col("total") / tiles) + F.least(k, F.col("total") % tiles) + 1)
    found = rows_at(rows, begins).agg(F.collect_list(F.struct("m", "v", "key")).alias("begins"))
    joined = df.crossJoin(F.broadcast(found))

    def tile(name: str) -> Column:
        own, at = value[name], F.col(f"`{key}`").cast("long")
        return (1 + F.size(F.filter("begins", lambda b: (b.m == name) & ((b.v < own) | (b.v == own) & (b.key <= at))))).alias(name)

    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *map(tile, orders))


def percentiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """One row: p, the exact percentiles of a numeric column, as percentile() gives them, and its least, greatest and mean.

    The values are counted and laid out once by ranges, a row a distinct value, so a value that very many rows share
    makes no range larger. The ranges' sizes tell which of them hold a rank, and only those are put in order. Without
    values the row holds nulls.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("w"))
    values = staged(counts.repartitionByRange("v").select("v", "w", F.spark_partition_id().alias("part")), "values")
    parts = values.groupBy("part").agg(F.sum("w").alias("size"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.sum(F.col("v") * F.col("w")).alias("sum"))
    # a row a range, as many as the session shuffles to
    whole, upto = Window.partitionBy(), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("size").over(whole)
    facts = F.struct(total.alias("total"), F.min("least").over(whole).alias("least"), F.max("greatest").over(whole).alias("greatest"), (F.sum("sum").over(whole) / total).alias("mean"))
    place = [F.lit(q) * (F.col("facts.total") - 1) for q in shares]
    ranks = F.array(*(x for p in place for x in (F.floor(p) + 1, F.ceil(p) + 1)))
    asked = F.transform(ranks, lambda r, k: F.struct(k.alias("k"), (r - F.col("before")).alias("place")))
    cells = parts.select("part", "size", (F.sum("size").over(upto) - F.col("size")).alias("before"), facts.alias("facts"))
    cells = cells.select("part", "facts", F.filter(asked, lambda x: (x["place"] > 0) & (x["place"] <= F.col("size"))).alias("asked")).filter(F.size("asked") > 0)
    reached = F.sum("w").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    held = values.join(F.broadcast(cells), "part").withColumn("reached", reached)
    met = F.filter("asked", lambda x: (x["place"] <= F.col("reached")) & (x["place"] > F.col("reached") - F.col("w")))
    found = held.select("facts", "v", F.explode(F.transform(met, lambda x: x["k"])).alias("k"))
    ends = found.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("ends"), F.first("facts").alias("facts"))

    def between(i: int, p: Column) -> Column:
        low, high, more = F.col("ends")[2 * i], F.col("ends")[2 * i + 1], p - F.floor(p)
        return F.when(low == high, low).otherwise(low * (1 - more) + high * more)

    return ends.select(F.array(*(between(i, p) for i, p in enumerate(place))).alias("p"), "facts.least", "facts.greatest", "facts.mean")


def with_median(df: DataFrame, column: str, name: str, totals: DataFrame) -> DataFrame:
    """The one-row totals of df and the median of one of its columns."""
    return totals.crossJoin(F.broadcast(percentiles(df, column, (0.5,)).select(F.col("p")[0].alias(name))))
