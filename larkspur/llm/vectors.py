"""Approximate nearest neighbours by balanced posting lists with replicated boundary vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import rows_of, staged

#: Different vectors that the centroids are fitted on, at most: those with the smallest hash of the id.
FIT_ROWS = 32_768
#: Different vectors a list is meant for, and lists at most.
LIST_ROWS, MOST_LISTS = 64, 2048
#: Lists that a boundary vector is written to, and how much farther than the nearest their centroids may be.
REPLICAS, BOUNDARY = 6, 1.25
#: Lists that a query reads at least and at most, and how much farther than the nearest the centroids of the further ones may be.
LEAST_PROBES, PROBES, RATIO = 12, 64, 1.6
#: Neighbours of a centroid in the graph, and centroids that a search keeps in view.
DEGREE, BEAM = 24, 96
#: Vectors and queries that meet in one piece of a list, at most about.
PIECE, QUERY_PIECE = 4096, 1024


@dataclass
class CentroidGraph:
    """Centroids with links to their nearest others, searched best first."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> CentroidGraph:
        k = len(centroids)
        d = _squares(centroids, centroids)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(DEGREE, max(1, k - 1))]
        # a ring through all centroids keeps every one in reach
        ring = np.column_stack([np.roll(np.arange(k), 1), np.roll(np.arange(k), -1)])
        return cls(centroids, np.column_stack([near, ring]).astype(np.int32) % k, np.unique(np.linspace(0, k - 1, min(k, 32)).astype(np.int32)))

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest centroids found, nearest first, and their distances; missing ones are infinitely far."""
        parts = [self._search(x[i : i + 512], want) for i in range(0, len(x), 512)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        k, m, beam = len(self.centroids), len(x), max(BEAM, want)
        rows = np.arange(m)
        seen, done = np.zeros((m, k), bool), np.zeros((m, k), bool)
        ids = np.broadcast_to(self.entries, (m, len(self.entries))).copy()
        dist = _squares(x, self.centroids[self.entries])
        seen[:, self.entries] = True
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            open_ = ~np.take_along_axis(done, ids, 1) & np.isfinite(dist)
            live = open_.any(axis=1)
            if not live.any():
                break
            at = ids[rows, np.argmax(open_, axis=1)]
            done[rows[live], at[live]] = True
            nxt = self.links[at]
            d = ((x[:, None, :] - self.centroids[nxt]) ** 2).sum(axis=2)
            d[np.take_along_axis(seen, nxt, 1) | ~live[:, None]] = np.inf
            seen[rows[:, None], nxt] |= live[:, None]
            ids, dist = np.concatenate([ids, nxt], axis=1), np.concatenate([dist, d], axis=1)
        return ids[:, :want], np.sqrt(np.maximum(dist[:, :want], 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :], 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, balance: float = 0.3) -> np.ndarray:
    """k-means in which a centroid costs more the more vectors it had in the last round."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    sizes = np.full(k, len(x) / k)
    for _ in range(rounds):
        own, gap = np.empty(len(x), np.int64), 0.0
        for i in range(0, len(x), 4096):
            d = _squares(x[i : i + 4096], c)
            gap += float(d.min(axis=1).sum())
            own[i : i + 4096] = np.argmin(d + balance * (gap / (i + len(d))) * (sizes * k / len(x) - 1), axis=1)
        sizes = np.bincount(own, minlength=k).astype(float)
        sums = np.zeros_like(c, dtype=np.float64)
        np.add.at(sums, own, x)
        full = sizes > 0
        c[full] = (sums[full] / sizes[full, None]).astype(c.dtype)
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


def takes_part(vector: str) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    return F.expr(f"coalesce(size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists({vector}, x -> x <> 0), false)")


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 10, columns: tuple[str, str] = ("vec_id", "embedding")) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for every row of vectors where `queries` holds.

    Equal vectors are indexed once, with the k + 1 smallest of their ids. Centroids are fitted on FIT_ROWS of them
    and searched by graph; every vector goes to its nearest list and, near a boundary, to others whose centroid is
    nearer to it than to those chosen; a query reads the lists whose centroid is within RATIO of the nearest one's
    distance. Large lists are cut into pieces. Distances are Euclidean, in double precision, from the vectors given.

    Null, zero and non-finite vectors take no part, nor do vectors of another length than the most frequent one (the
    shorter, if tied) or with a null id. Repeated rows count once; ties go to the smaller id. With fewer than k + 1
    vectors all others are returned. An empty table gives no rows. Extra columns are ignored.
    """
    key, vector = columns
    spark = vectors.sparkSession
    rows = vectors.withColumn("is_query", F.coalesce(queries, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), "is_query").filter(F.col("id").isNotNull() & takes_part("v"))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], result)
    rows = rows.filter(F.size("v") == length.d)
    same = Window.partitionBy("v").orderBy("id")
    members = rows.select("id", "v", F.dense_rank().over(same).alias("nth")).filter(F.col("nth") <= k + 1)
    members = staged(members.withColumn("rep", F.min("id").over(Window.partitionBy("v"))).distinct(), "members")
    reps = members.filter("nth = 1").select("id", "v").dropDuplicates(["id", "v"])
    asked = staged(rows.filter("is_query").select(F.col("id").alias("query_id"), "v").distinct().join(reps.withColumnRenamed("id", "rep"), "v"), "queries")
    n = reps.count()
    fit = reps.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    x = np.asarray(fit.flatten(), dtype=np.float64).reshape(-1, length.d).astype(np.float32)
    graph = spark.sparkContext.broadcast(CentroidGraph.of(balanced_centroids(x, max(1, min(MOST_LISTS, n // LIST_ROWS, len(x) // 8)))))

    def lists(name: str, most: int, ratio: float, least: int = 1, spread: bool = False):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                g = graph.value
                column = batch.column(batch.schema.get_field_index("v"))
                own = np.asarray(column.flatten(), dtype=np.float64).astype(np.float32).reshape(batch.num_rows, -1)
                near, far = g.search(own, min(4 * most if spread else most, len(g.centroids)))
                keep = np.isfinite(far) & ((far <= ratio * far[:, :1]) | (np.arange(far.shape[1]) < least))
                if spread:
                    keep = _spread(g.centroids, near, far, keep, most)
                row, col = np.nonzero(keep)
                ids = batch.column(batch.schema.get_field_index(name))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(near[row, col].astype(np.int32)), ids.take(take), column.take(take)], names=["list", "id", "v"])

        return of

    kind = dict(rows.dtypes)["v"]
    schema = f"list int, id long, v {kind}"
    posts = reps.mapInArrow(lists("id", REPLICAS, BOUNDARY, spread=True), schema)
    probes = asked.select("rep", "v").dropDuplicates(["rep"]).mapInArrow(lists("rep", PROBES, RATIO, LEAST_PROBES), schema)
    posts, probes = staged(posts, "posting-lists"), staged(probes, "probes")
    hits = staged(_search(posts, probes, k), "hits")
    enough = hits.groupBy("rep").count().filter(F.col("count") >= min(k + 1, n)).select("rep")
    short = probes.select(F.col("id").alias("rep"), "v").dropDuplicates(["rep"]).join(enough, "rep", "left_anti")
    # a query whose lists hold too few vectors, which a lone centroid may bring about, reads all lists
    every = short.select(F.explode(F.sequence(F.lit(0), F.lit(len(graph.value.centroids) - 1))).alias("list"), F.col("rep").alias("id"), "v")
    every = staged(every.select(F.col("list").cast("int").alias("list"), "id", "v"), "probes")
    if not every.isEmpty():
        hits = hits.unionByName(_search(posts, every, k)).groupBy("rep", "near").agg(F.min("d").alias("d"))
    best = hits.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("d", "near"))).filter(F.col("nth") <= k + 1).select("rep", "near", "d")
    copies = members.select(F.col("rep").alias("near"), F.col("id").alias("vec_id"))
    pairs = asked.select("query_id", "rep").join(best, "rep").join(copies, "near").filter("vec_id <> query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("d").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(posts: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """rep, near, d: the k + 1 nearest of every list that a query reads. Both tables are rows of list, id, v."""
    pieces = posts.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    lots = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_PIECE).cast("int").alias("lots"))
    cut = staged(pieces.join(lots, "list"), "list-pieces")  # a row for each of MOST_LISTS lists at most
    part = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    lot = F.pmod(F.xxhash64("id"), F.col("lots")).cast("int")
    held = posts.join(F.broadcast(cut), "list").select("list", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(False).alias("asks"), "id", "v")
    asking = probes.join(F.broadcast(cut), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("part"), lot.alias("lot"), F.lit(True).alias("asks"), "id", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A piece's vectors, then the queries on it."""

        def found() -> pa.RecordBatch:
            out = [np.empty(0, np.int64)] * 2 + [np.empty(0)]
            if ids[0] and ids[1]:
                v, q = (np.asarray(vs, dtype=np.float64) for vs in vecs)
                own = np.array(ids[0])
                rough = _squares(q, v)
                want = min(len(own), 2 * k + 12)
                best = np.argpartition(rough, want - 1, axis=1)[:, :want]
                d = np.sqrt(((q[:, None, :] - v[best]) ** 2).sum(axis=2))
                order = np.lexsort((own[best], d), axis=1)[:, : k + 1]
                best, d = np.take_along_axis(best, order, 1), np.take_along_axis(d, order, 1)
                out = [np.repeat(np.array(ids[1]), best.shape[1]), own[best].ravel(), d.ravel()]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["rep", "near", "d"])

        group, ids, vecs = None, ([], []), ([], [])
        for batch in batches:
            for a, b, c, asks, i, v in rows_of(batch, "list", "part", "lot", "asks", "id", "v"):
                if (a, b, c) != group:
                    yield found()
                    group, ids, vecs = (a, b, c), ([], []), ([], [])
                ids[asks].append(i)
                vecs[asks].append(v)
        yield found()

    keys = ["list", "part", "lot"]
    hits = held.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(compare, "rep long, near long, d double")
    return hits.groupBy("rep", "near").agg(F.min("d").alias("d"))


def _spread(centroids: np.ndarray, near: np.ndarray, far: np.ndarray, keep: np.ndarray, most: int) -> np.ndarray:
    """Of the lists in reach those whose centroid is nearer to the vector than to every centroid chosen before it."""
    out = np.zeros_like(keep)
    out[:, 0] = True
    for j in range(1, near.shape[1]):
        gap = np.sqrt(((centroids[near[:, j]][:, None, :] - centroids[near[:, :j]]) ** 2).sum(axis=2))
        gap[~out[:, :j]] = np.inf
        out[:, j] = keep[:, j] & (gap > far[:, j : j + 1]).all(axis=1) & (out.sum(axis=1) < most)
    return out
