"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import staged

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one source and size are ranked in this many hash buckets, so that no hot size meets in one task.
BUCKETS = 256
#: The dynamic programming works on a remaining budget of at least this many words, documents given back for it included.
DP_WORDS = 1 << 16


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their sizes come as near to the budget as they can from below.

    First each size gives its share of the budget in proportion, rounded down, and the longest documents fill up to
    DP_WORDS below the budget. Then the shortest documents are given back until that much is open again, and a
    bounded-knapsack table over all that isn't taken finds the best sum. So the sum is the best of all for budgets
    within DP_WORDS, and for larger ones the best that keeps what wasn't given back.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable"):
        n = min(int(counts[i] - take[i]), max(0, left - DP_WORDS) // int(sizes[i]))
        take[i] += n
        left -= n * int(sizes[i])
    for i in np.argsort(sizes, kind="stable"):
        n = min(int(take[i]), max(0, DP_WORDS - left) // int(sizes[i]))
        take[i] -= n
        left += n * int(sizes[i])
    reached, mask = 1, (1 << (left + 1)) - 1
    came: dict[int, tuple[int, int]] = {}
    for i in np.argsort(-sizes, kind="stable"):
        free, lot, s = int(min(counts[i] - take[i], left // sizes[i])), 1, int(sizes[i])
        while free and not reached >> left & 1:
            lot = min(lot, free)
            new = (reached << lot * s) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                came.update(dict.fromkeys(np.flatnonzero(bits).tolist(), (int(i), lot)))
                reached |= new
            free, lot = free - lot, lot * 2
    at = reached.bit_length() - 1
    while at:
        i, lot = came[at]
        take[i] += lot
        at -= lot * int(sizes[i])
    return take


def source_targets(sources: DataFrame, share: float, weights: Sequence[int], most: int) -> DataFrame:
    """Adds `target` to rows (source, source_size): the level that shares share * sum by weight under the caps most * size."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    # while sources are capped in order of cap / weight the level of the others rises, then it falls: the highest one holds
    return (
        sources.withColumn("rank", rank)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("all") - capped) / open_weight)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def mix_sources(
    docs: DataFrame, share: float = 1.5, weights: Sequence[int] = (5, 2, 1), most: int = 2, seed: int = 17,
    columns: tuple[str, str, str] = ("doc_id", "text", "source"), size: Column | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of docs.

    Sources in code point order, null last, weigh `weights` in turn and share `share` of all sizes; none gets more
    than `most` times its own size. Each source takes all of its documents as often as its target allows, then
    fit_budget() says how many documents of each size come once more, and the seeded hash of the id says which.
    Texts are read once; all further steps work on rows of id, source and size.

    Null or empty texts have size 0 and take no words. Null ids are ranked like any other; rows with equal id,
    source and size are interchangeable. An empty table gives no rows. Extra columns are ignored.
    """
    key, text, source = columns
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)) if size is None else size
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    slim = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.cast("long").alias("size"))
    slim = staged(slim.withColumn("bucket", F.pmod(order, F.lit(BUCKETS)).cast("int")), "mix-sizes")
    cells = slim.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, weights, most)

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        own, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        rows = rows.sort_values("size", kind="stable")
        rows["base"], rows["extra"] = 0, 0
        if own:
            base = int(target // own)
            some = (rows["size"] > 0).to_numpy()
            extra = np.zeros(len(rows), dtype=np.int64)
            extra[some] = fit_budget(rows["size"].to_numpy()[some], rows["n"].to_numpy()[some], round(target) - base * own) if base < most else 0
            rows["base"], rows["extra"] = base, extra
        return rows[["source", "size", "base", "extra", "source_size", "target"]]

    t, s, c = targets.alias("t"), sizes.alias("s"), cells.alias("c")
    joined = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "size", "n", "source_size", "target")
    plans = joined.groupBy("source").applyInPandas(plan, "source string, size long, base long, extra long, source_size long, target double").alias("p")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c.source", "c.size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = (
        c.join(plans, F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size")))
        .withColumn("room", F.col("extra") - before)
        .select("c.source", "c.size", "bucket", "base", "room", "source_size", "target")
        .alias("h")
    )
    nth = F.row_number().over(Window.partitionBy("d.source", "d.size", "d.bucket").orderBy(order, "doc_id"))
    return (
        slim.alias("d")
        .join(shares, F.col("d.source").eqNullSafe(F.col("h.source")) & (F.col("d.size") == F.col("h.size")) & (F.col("d.bucket") == F.col("h.bucket")))
        .withColumn("copies", F.col("base") + (nth <= F.col("room")).cast("long"))
        .select("doc_id", "d.size", "source_size", "target", (F.col("copies") * F.col("d.size")).alias("taken"), "copies")
    )
