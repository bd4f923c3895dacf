"""Centroid clustering over blocks of vectors in the order of a Hilbert curve, with zone maps that tell which centroids a block needs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, staged

#: Vectors that the curve's axes and the ranges are fitted on, at most: those with the smallest hash of the id. They decide the layout only, never a result.
FIT_ROWS = 16_384
#: Principal axes that the curve runs through, and bits of each; the key's last SALT_BITS part equal places of the curve.
AXES, BITS, SALT_BITS = 10, 4, 20
#: Vectors of a block at most, and of a cell of the curve that is not cut further.
BLOCK, CELL = 512, 8
#: Two neighbouring cells make one block if that makes the squared extents of their boxes, a vector, at most so many times larger.
GROWTH = 2
#: Vectors that a range of the curve is meant for, and ranges at most; beyond, ranges grow and are cut by hash.
RANGE_ROWS, MOST_RANGES, SLICE_ROWS = 4096, 4096, 1 << 20
#: Components beyond this have distances that a long can't hold.
MOST = 1 << 27
#: Up to this, products and sums of 64 components are exact in doubles.
_EXACT = 1 << 22


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells, whose columns hold `bits` bits each (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the rotations, from the coarsest bit
        low = bit - 1
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> b & 1)
    return place


@dataclass
class Layout:
    """Axes of the curve, the cuts of each axis, and the keys that cut the curve into ranges."""

    centre: np.ndarray
    axes: np.ndarray
    cuts: np.ndarray
    ranges: np.ndarray
    slices: int

    @classmethod
    def of(cls, x: np.ndarray, rows: int) -> Layout:
        centre = x.mean(axis=0)
        _, axes = np.linalg.eigh(np.cov((x - centre).T) if len(x) > 1 else np.eye(x.shape[1]))
        axes = axes[:, ::-1][:, :AXES]
        cuts = np.quantile((x - centre) @ axes, np.arange(1, 1 << BITS) / (1 << BITS), axis=0).T
        out = cls(centre, axes, cuts, np.empty(0, np.int64), 1)
        ranges = max(1, min(MOST_RANGES, rows // RANGE_ROWS, len(x) // 4))
        keys = np.sort(out.keys(x, np.arange(len(x))))
        return cls(centre, axes, cuts, keys[np.arange(1, ranges) * len(keys) // ranges], -(-rows // (ranges * SLICE_ROWS)))

    def keys(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        seen = (x - self.centre) @ self.axes
        cells = np.stack([np.searchsorted(c, seen[:, i]) for i, c in enumerate(self.cuts)], axis=1)
        salt = number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SALT_BITS)
        return hilbert_places(cells, BITS) << SALT_BITS | salt.astype(np.int64)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to some vector of the box, ties included, in ascending order.

    First those whose least distance from the box is no more than the least of all greatest distances. Of these, one is
    left out if in every corner of the box another, the one nearest to the box's middle, is strictly nearer: the
    difference of two squared distances is linear in the vector, so its least value lies in a corner.
    """
    near = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    far = np.maximum(centroids - low, high - centroids)
    reach = (far * far).sum(axis=1).min()
    held = np.flatnonzero((near * near).sum(axis=1) <= reach)
    if len(held) == 1:
        return held
    c = centroids[held]
    middle = low + high - 2 * c
    lead = c[np.argmin((middle * middle).sum(axis=1))]
    gap = 2 * (lead - c)
    least = (np.minimum(gap * low, gap * high)).sum(axis=1) + (c * c).sum(axis=1) - (lead * lead).sum()
    return held[least <= 0]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first nearest centroid and the squared distance, both exact."""
    if max(np.abs(x).max(), np.abs(centroids).max()) <= _EXACT:
        v, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    own = np.argmin(d, axis=1)
    return own, d[np.arange(len(x)), own].astype(np.int64)


def zone_cuts(x: np.ndarray, key: np.ndarray) -> list[int]:
    """Where the blocks of vectors in order of their keys end.

    The curve's cells are halved by the bits of the key down to CELL vectors. Halves are joined again, up to BLOCK
    vectors, where the joined box is not much larger than theirs: vectors in groups get small boxes, and others few blocks.
    """

    def of(lo: int, hi: int) -> tuple[list[int], np.ndarray, np.ndarray, float]:
        """The ends, the box, and the sum over vectors of their block's squared extents."""
        bits = int(key[lo] ^ key[hi - 1]).bit_length()
        if hi - lo <= CELL or not bits and hi - lo <= BLOCK:
            low, high = x[lo:hi].min(axis=0), x[lo:hi].max(axis=0)
            return [hi], low, high, (hi - lo) * float(((high - low).astype(np.float64) ** 2).sum())
        mid = lo + int(np.searchsorted(key[lo:hi], key[hi - 1] >> bits - 1 << bits - 1)) if bits else (lo + hi) // 2
        (a, a_low, a_high, a_all), (b, b_low, b_high, b_all) = of(lo, mid), of(mid, hi)
        low, high = np.minimum(a_low, b_low), np.maximum(a_high, b_high)
        joined = (hi - lo) * float(((high - low).astype(np.float64) ** 2).sum())
        if hi - lo <= BLOCK and len(a) == len(b) == 1 and joined <= GROWTH * (a_all + b_all):
            return [hi], low, high, joined
        return a + b, low, high, a_all + b_all

    return of(0, len(x))[0]


def zone_blocks(rows: DataFrame, components: int) -> DataFrame:
    """ids, low, high, vectors: rows of id and integer vector v, laid out in blocks along a Hilbert curve, staged.

    The curve runs through principal axes, cut at quantiles. The curve is cut into ranges of like size by a sample's
    keys; a number of the row ends each key, so equal vectors spread over as many ranges as they fill. Ranges are sorted
    and cut into blocks (zone_cuts), each with the least and the greatest value of every component.
    """
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks()
    layout = rows.sparkSession.sparkContext.broadcast(Layout.of(np.asarray(sample.flatten(), dtype=np.float64).reshape(-1, components), n))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = TaskContext.get().partitionId() << 40, layout.value
        for batch in batches:
            number = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            key = own.keys(np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(-1, components), number)
            lot = np.searchsorted(own.ranges, key, side="right") * own.slices + number % own.slices
            yield pa.RecordBatch.from_arrays([pa.array(lot), pa.array(key), batch.column(0), batch.column(1)], names=["lot", "key", "id", "v"])

    def blocks(lot: list[pa.RecordBatch]) -> pa.RecordBatch:
        key = np.concatenate([b.column(1).to_numpy() for b in lot])
        ids = pa.concat_arrays([b.column(2) for b in lot])
        x = np.concatenate([np.asarray(b.column(3).flatten(), dtype=np.int32) for b in lot]).reshape(-1, components)
        ends = zone_cuts(x, key)
        parts = [x[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        boxes = [(p.min(axis=0), p.max(axis=0)) for p in parts]
        kinds = [np.int16 if max(-int(low.min()), int(high.max())) < 1 << 15 else np.int32 for low, high in boxes]
        cols = [[low.tobytes() for low, _ in boxes], [high.tobytes() for _, high in boxes], [p.astype(k).tobytes() for p, k in zip(parts, kinds, strict=True)]]
        listed = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([listed, *(pa.array(c, pa.binary()) for c in cols)], names=["ids", "low", "high", "vectors"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by lot and key, up to RANGE_ROWS of a lot at a time."""
        held, rows, of = [], 0, None
        for batch in batches:
            lots = batch.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), len(lots)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if hi > lo and lots[lo] != of:
                    if held:
                        yield blocks(held)
                    held, rows, of = [], 0, lots[lo]
                while lo < hi:
                    more = min(hi - lo, 2 * RANGE_ROWS - rows)
                    held.append(batch.slice(lo, more))
                    lo, rows = lo + more, rows + more
                    if rows == 2 * RANGE_ROWS:
                        yield blocks(held)
                        held, rows = [], 0
        if held:
            yield blocks(held)

    dealt = rows.select("id", "v").mapInArrow(placed, "lot long, key long, id long, v array<int>").repartition("lot").sortWithinPartitions("lot", "key")
    return staged(dealt.mapInArrow(cut, "ids array<bigint>, low binary, high binary, vectors binary"), "blocks")


def _of(low: bytes, high: bytes, vectors: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = np.frombuffer(low, np.int32).astype(np.int64), np.frombuffer(high, np.int32).astype(np.int64)
    kind = np.int16 if len(vectors) == 2 * n * len(low) else np.int32
    return low, high, np.frombuffer(vectors, kind).reshape(n, -1).astype(np.int64)


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of every block its ids, vectors, their clusters and distances, and how many centroids were compared."""
    listed = batch.column(0)
    for i, (low, high, vectors) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
        ids = listed[i].values
        low, high, x = _of(low, high, vectors, len(ids))
        may = candidates(low, high, centroids)
        own, far = nearest(x, centroids[may])
        yield ids, x, may[own], far, len(may)


def moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: each floor(sum / count) of the vectors nearest to it; one without vectors stays."""
    shared = blocks.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums, counts = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            for _, x, own, _, _ in _assigned(batch, c):
                for k in np.unique(own):
                    sums[k] += x[own == k].sum(axis=0)
                counts += np.bincount(own, minlength=len(c))
        full = np.flatnonzero(counts)
        width = c.shape[1]
        cols = [np.repeat(full, width), np.tile(np.arange(width), len(full)), sums[full].ravel(), np.repeat(counts[full], width)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["cluster", "place", "total", "rows"])

    parts = blocks.mapInArrow(summed, "cluster long, place long, total long, rows long")
    # a row for each component of each centroid
    new = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("rows").alias("rows")).collect():
        new[r.cluster][r.place] = int(r.total) // r.rows
    shared.unpersist()
    return new


def assigned(blocks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """id, cluster, distance, compared: every vector's nearest centroid, and how many its block was compared with."""
    shared = blocks.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, own, far, compared in _assigned(batch, shared.value):
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(far), pa.array(np.full(len(own), compared, np.int32))], names=["id", "cluster", "distance", "compared"])

    return blocks.mapInArrow(of, "id long, cluster int, distance long, compared int")


def kept_vectors(vectors: DataFrame, components: int, scale: int, columns: tuple[str, str]) -> DataFrame:
    """id, v: the vectors with so many components, all finite, as integers floor(scale * x)."""
    key, vector = (F.col(f"`{c}`") for c in columns)
    whole = F.expr(f"size(v) = {components} AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = vectors.select(key.cast("long").alias("id"), vector.alias("v")).filter(F.coalesce(whole, F.lit(False)))
    size = F.expr(f"transform(v, x -> floor({scale} * CAST(x AS DOUBLE)))")
    fits = F.expr(f"forall(f, x -> abs(x) <= {MOST})")
    return rows.select("id", size.alias("f")).select("id", F.when(fits, F.expr("transform(f, x -> CAST(x AS INT))")).otherwise(F.raise_error(F.lit("a component is too large for distances of 64 bits"))).alias("v"))


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, seed: int = 2, columns: tuple[str, str] = ("vec_id", "embedding")) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and compared (centroids that its block needed), a row for each vector kept.

    Vectors of `components` finite components are kept, as integers floor(scale * x). The first centroids are the k with
    the smallest SHA-256 of `seed:id`. Every round assigns each vector to the nearest centroid (ties: the smaller
    number) and moves each centroid to the floored mean of its vectors; one without vectors stays. All of it is exact.

    The vectors are laid out once in blocks along a Hilbert curve. A round tells each block's candidate centroids from the
    distances of its box and compares its vectors with those alone; the driver holds k centroids and nothing else.

    Null vectors, those of another length and those with a null or non-finite component have no row. Null ids are
    clustered but never first centroids unless all are (they sort last); repeated rows each count, and of equal hashes
    the smaller vector comes first. With fewer than k vectors each is a first centroid; equal ones leave the later
    number empty. A component beyond 2**27 after scaling raises an error: its distances don't fit a long. An empty table
    gives no rows. Extra columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int"
    rows = kept_vectors(vectors, components, scale, columns)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = [list(r.v) for r in rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()]
    if not centroids:
        return spark.createDataFrame([], result)
    blocks = zone_blocks(rows, components)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    out = staged(assigned(blocks, centroids), "clusters")
    discard(blocks)
    shas = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    each = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    told = each.join(shas, "cluster").crossJoin(F.broadcast(each.agg(F.sum("cluster_inertia").alias("inertia"))))
    return out.join(F.broadcast(told), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
