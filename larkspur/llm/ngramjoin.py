"""Jaccard join of word shingle sets with signature trees, and the components of its links."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, discard, giving_back, rows_of, staged

#: Words of a shingle, and least similarity in hundredths.
WORDS, PERCENT = 5, 75
#: A set of n shingles has 1 + n // EXTRA keys more than one common key takes: sets that link share as many keys.
EXTRA = 8
#: Least and most bits of a set's signature; a set has 8 to 16 bits a shingle between them.
LEAST_BITS, MOST_BITS = 2048, 65_536
#: Most bits of a node's bitmap, and the share of its smallest set's shingles that chance may find in another node's bitmap like it.
NODE_BITS, CHANCE = 1 << 20, 0.3
#: Sets in a leaf of a signature tree; sets and shingles that one tree holds, and a share of them that is enough where only trees are searched.
LEAF, TREE, TREE_SHINGLES, FIRST_SHARE = 8, 4096, 1 << 21, 8
#: Sets and shingles of small groups that one tree takes together, about; a group with an eighth of either is no small one.
TOGETHER, TOGETHER_SHINGLES = 512, 1 << 18
#: A key in this share of a lot's sets is dealt to so many tasks by lot.
HOT_SHARE, SALTS = 0.05, 64
#: Keys by which each set is first joined with others.
FIRST_KEYS = 2
#: Bytes of text that are hashed at a time, and whose keys are looked at together.
LOT_BYTES, KEY_LOT_BYTES = 1 << 20, 1 << 22

#: A word's hash is the sum of a random number for each byte times a power of an odd number, modulo 2**64.
_BYTES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    white = _WHITE[raw]
    starts = np.flatnonzero(~white & np.append(True, white[:-1]))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = np.diff(starts, append=len(raw))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)
    value = np.where(white, np.uint64(0), _BYTES[raw])[starts[0] :]
    ends = np.flatnonzero(white & np.append(False, ~white[:-1]))  # powers reach as far as the longest word, not the longest gap
    longest = int((np.append(ends, len(raw))[: len(starts)] - starts).max())
    power = np.cumprod(np.append(np.uint64(1), np.full(longest, _POWER)), dtype=np.uint64)
    return _mixed(np.add.reduceat(value * power[np.minimum(place, longest)], starts - starts[0])), starts


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles, worked out for many texts at a time.

    Two different shingles in a corpus of n meet by chance once in 2**64 / n. A-Z are lower-cased and ASCII white
    space ends words; no other character is touched.
    """
    for lot in _lots((t or "").encode().lower() for t in texts):
        h, starts = _word_hashes(np.frombuffer(b"\n".join(lot), np.uint8))
        firsts = np.cumsum([0, *(len(t) + 1 for t in lot)])
        cuts = np.searchsorted(starts, firsts)
        full = np.full(max(0, len(h) - WORDS + 1), WORDS, np.uint64)
        for i in range(WORDS):
            full = full * _POWER + h[i : len(h) - WORDS + 1 + i] if len(full) else full
        full = _mixed(full)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo >= WORDS:
                own = np.sort(full[lo : hi - WORDS + 1])
                yield own[np.append(True, own[1:] != own[:-1])]
            elif hi > lo:
                one = np.full(1, hi - lo, np.uint64)
                for x in h[lo:hi]:
                    one = one * _POWER + x
                yield _mixed(one)
            else:
                yield np.empty(0, np.uint64)


def _lots(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    lot, size = [], 0
    for t in texts:
        if lot and size + len(t) > LOT_BYTES:
            yield lot
            lot, size = [], 0
        lot.append(t)
        size += len(t)
    if lot:
        yield lot


def set_id(own: np.ndarray) -> int:
    """A set's number: the hash of its shingles."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(shingles: np.ndarray, width: int) -> np.ndarray:
    """A bit for each shingle, at its hash modulo the width, a power of two."""
    bits = np.zeros(width, np.uint8)
    bits[(shingles >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _width(bits: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << (math.ceil(bits) - 1).bit_length()))


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a smaller width."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def prefix_length(n: int) -> int:
    """Keys of a set of n shingles: of its shingles in order of hash, so many that two sets that link share 1 + n // EXTRA of the smaller one's."""
    return n - (PERCENT * n + 99) // 100 + 1 + n // EXTRA


def least_shared(n: str) -> Column:
    """Keys that a set of this size shares at least with any set it links with, which may have PERCENT of its size."""
    return F.expr(f"1 + ((({PERCENT} * CAST({n} AS LONG) + 99) DIV 100) DIV {EXTRA})")


@giving_back
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every key of every distinct set of a lot of texts.

    Rows of a key that many sets of the lot have are salted, and a row without a node marks the key as shared.
    """
    for batch in batches:
        texts, lots, size = batch.column(0), [0], 0
        for i, length in enumerate(pa.compute.binary_length(texts).fill_null(0).to_pylist()):
            size += length
            if size > KEY_LOT_BYTES:
                lots.append(i + 1)
                size = 0
        for lo, hi in zip(lots, [*lots[1:], len(texts)], strict=True):
            sets = {set_id(own): own for own in shingle_sets(texts[lo:hi].to_pylist()) if len(own)}
            if not sets:
                continue
            sizes = np.array([len(own) for own in sets.values()])
            lengths = [prefix_length(int(n)) for n in sizes]
            key = np.concatenate([own[:m] for own, m in zip(sets.values(), lengths, strict=True)]).view(np.int64)
            own, again, times = np.unique(key, return_inverse=True, return_counts=True)
            hot = times >= max(8, HOT_SHARE * len(sets))
            salt = np.where(hot[again], next(iter(sets)) % SALTS, -1)
            marks = own[hot]
            node = np.concatenate([np.repeat(np.fromiter(sets, np.int64, len(sets)), lengths), np.zeros(len(marks), np.int64)])
            none = np.arange(len(node)) >= len(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key, marks])), pa.array(node, mask=none), pa.array(np.append(np.repeat(sizes, lengths), np.zeros(len(marks), int)).astype(np.int32)), pa.array(np.append(salt, np.full(len(marks), -1)).astype(np.int32))],
                names=["key", "node", "n", "salt"],
            )


def keyed_sets(docs: DataFrame) -> DataFrame:
    """node, n, keys: the sets that share as many keys with others as a link takes, with those keys.

    No key meets whole in one task: where it is frequent its rows are salted, and only marks meet.
    """
    rows = docs.select("text").mapInArrow(_keys, "key long, node long, n int, salt int")
    w = Window.partitionBy("key", "salt").orderBy("node")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"before": F.lag("node").over(w), "lo": F.min("node").over(whole), "hi": F.max("node").over(whole), "marked": F.max(F.col("node").isNull()).over(whole)})
    shared = rows.filter("node IS NOT NULL AND (before IS NULL OR before <> node) AND (salt >= 0 OR marked OR lo <> hi)")  # a node once: copies come from many lots
    return shared.groupBy("node").agg(F.first("n").alias("n"), F.collect_set("key").alias("keys")).filter(F.size("keys") >= least_shared("n"))


@giving_back
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(set_id(own), len(own)) for own in shingle_sets(x.as_py() for x in batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int32())], names=["doc_id", "ref", "node", "n"])


@giving_back
def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each node once a task; other texts under the same doc_id go."""
    seen: set[int] = set()
    for batch in batches:
        kept = []
        for i, (node, own) in enumerate(zip(batch.column(0).to_pylist(), shingle_sets(x.as_py() for x in batch.column(1)), strict=True)):
            if node not in seen and set_id(own) == node:
                seen.add(node)
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


class Below:
    """A node: its sets are places lo to hi in the tree's order, of `least` to `most` shingles each.

    bits is the OR of its sets' bitmaps, at a width that keeps chance hits few; None where that would take too many.
    crowd is how many of its different shingles share a bit with another: no set below has more that do.
    """

    __slots__ = ("lo", "hi", "least", "most", "bits", "crowd", "kids", "own")

    def __init__(self, lo: int, hi: int, sizes: np.ndarray, shingles: np.ndarray, kids: tuple[Below, Below] | None):
        self.lo, self.hi, self.kids, self.own = lo, hi, kids, None
        self.least, self.most = int(sizes.min()), int(sizes.max())
        # two nodes of `total` shingles hit each other's bits total**2 / width times by chance
        need = float(len(shingles)) ** 2 / (CHANCE * self.least)
        self.bits, self.crowd = None, 0
        if need <= NODE_BITS or kids is None:
            self.bits = bitmap(shingles, _width(need, LEAST_BITS, NODE_BITS))
            self.crowd = len(np.unique(shingles)) - int(np.bitwise_count(self.bits).sum())


class SignatureTree:
    """Sets under nodes that hold the OR of their bitmaps and the range of their sizes.

    labels tells the component of each set by its place in `at` and may change while pairs are read: nodes whose
    sets are all of one component are left out. seen counts the pairs of nodes that were looked at, and those that
    sizes, one label and bitmaps cut.
    """

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, at: np.ndarray | None = None):
        self.sets, self.labels = sets, labels
        self.at = np.arange(len(sets)) if at is None else at
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.seen = dict.fromkeys(("pairs", "sizes", "label", "bits", "leaves"), 0)
        flat, ends = np.concatenate(sets), np.append(0, np.cumsum(self.sizes))

        def grown(lo: int, hi: int) -> Below:
            mid = (lo + hi) // 2
            kids = (grown(lo, mid), grown(mid, hi)) if hi - lo > LEAF else None
            return Below(lo, hi, self.sizes[lo:hi], flat[ends[lo] : ends[hi]], kids)

        self.root = grown(0, len(sets))

    def _label(self, node: Below) -> int | None:
        own = self.labels[self.at[node.lo : node.hi]]
        return int(own[0]) if (own == own[0]).all() else None

    def pairs(self, other: SignatureTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of this and the other tree with different labels that may link; for a tree and itself, each pair once.

        Two sets share at most as many shingles as their nodes have bits in common, and those that hide behind another
        shingle's bit; bitmaps of two widths are compared at the smaller, where the smaller one's sets bound the rest.
        """
        todo, seen = [(self.root, other.root)], self.seen
        while todo:
            a, b = todo.pop()
            seen["pairs"] += 1
            if 100 * min(a.most, b.most) < PERCENT * max(a.least, b.least):
                seen["sizes"] += 1
                continue
            label = self._label(a)
            if label is not None and label == other._label(b):
                seen["label"] += 1
                continue
            if a is not b and a.bits is not None and b.bits is not None:
                low = a if len(a.bits) <= len(b.bits) else b
                words = len(low.bits)
                most = int(np.bitwise_count(_folded(a.bits, words) & _folded(b.bits, words)).sum()) + low.crowd
                if (100 + PERCENT) * min(most, a.most, b.most) < PERCENT * (a.least + b.least):
                    seen["bits"] += 1
                    continue
            if a.kids is None and b.kids is None:
                seen["leaves"] += 1
                yield from self._leaves(other, a, b)
            elif a is b:
                x, y = a.kids
                todo += [(x, y), (y, y), (x, x)]  # the halves come first: what they join is left out between them
            elif b.kids is None or a.kids is not None and a.hi - a.lo >= b.hi - b.lo:
                todo += [(x, b) for x in a.kids]
            else:
                todo += [(a, x) for x in b.kids]

    def _own(self, leaf: Below) -> tuple[np.ndarray, np.ndarray]:
        """The bitmaps of a leaf's sets, at one width, and how many bits each has."""
        if leaf.own is None:
            width = _width(8 * leaf.most, LEAST_BITS, MOST_BITS)
            sigs = np.stack([bitmap(x, width) for x in self.sets[leaf.lo : leaf.hi]])
            leaf.own = sigs, np.bitwise_count(sigs).sum(axis=1).astype(np.int64)
        return leaf.own

    def _leaves(self, other: SignatureTree, a: Below, b: Below) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A set's overlap with another is its size less the bits it has outside the other's bitmap, at most."""
        (x, x_pops), (y, y_pops) = self._own(a), other._own(b)
        if x.shape[1] != y.shape[1]:
            words = min(x.shape[1], y.shape[1])
            x, y = (np.stack([_folded(r, words) for r in z]) for z in (x, y))
            x_pops, y_pops = (np.bitwise_count(z).sum(axis=1).astype(np.int64) for z in (x, y))
        both = np.bitwise_count(x[:, None] & y[None]).sum(axis=2).astype(np.int64)
        n, m = self.sizes[a.lo : a.hi, None], other.sizes[None, b.lo : b.hi]
        most = np.minimum(n - (x_pops[:, None] - both), m - (y_pops[None] - both))
        may = ((100 + PERCENT) * most >= PERCENT * (n + m)) & (self.labels[self.at[a.lo : a.hi]][:, None] != other.labels[other.at[b.lo : b.hi]][None])
        if a is b:
            may = np.triu(may, 1)
        i, j = np.nonzero(may)
        if len(i):
            yield i + a.lo, j + b.lo


def joined_labels(nodes: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (label, label) that make one component of all whose sets link, at most as many as there are labels.

    A side's sets are in one tree, in order of bands of their size and then of their smallest shingle, which near copies
    mostly share. The trees are traversed in pairs and what the bounds don't rule out is compared shingle by shingle,
    unless its labels have met meanwhile.
    """
    first, labels = labels, labels.copy()
    sizes = np.array([len(own) for own in sets], np.int64)
    known, every = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(every, np.cumsum(sizes)[:-1])
    held = np.zeros(len(known), bool)
    bands = np.floor(np.log(sizes) / math.log(1.15))
    order = np.lexsort((nodes, [x[0] for x in sets], bands))
    trees = [SignatureTree([sets[i] for i in at], labels, at) for side in (0, 1) if len(at := order[sides[order] == side])]
    for i, j in trees[0].pairs(trees[-1]):
        i, j = trees[0].at[i], trees[-1].at[j]
        for x in np.unique(i):
            others = j[i == x]
            others = others[labels[others] != labels[x]]
            if not len(others):
                continue
            held[own[x]] = True
            both = np.add.reduceat(held[np.concatenate([own[y] for y in others])].astype(np.int64), np.cumsum(np.append(0, sizes[others[:-1]])))
            held[own[x]] = False
            for y in others[100 * both >= PERCENT * (sizes[x] + sizes[others] - both)]:
                p, q = sorted((labels[x], labels[y]))
                labels[labels == q] = p
    return sorted(set(zip(labels[labels != first].tolist(), first[labels != first].tolist(), strict=True)))


@giving_back
def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mixed, group, p, q, side, node, label, text) sorted by the first four: the edges that each group's trees find."""
    group, held = None, {}

    def found() -> pa.RecordBatch:
        edges: list[tuple[int, int]] = []
        if len(held) > 1 and (group[2] == group[3] or len({side for side, *_ in held.values()}) > 1):
            sides, labels, texts = zip(*held.values(), strict=True)
            edges = joined_labels(np.fromiter(held, np.int64, len(held)), np.array(labels, np.int64), np.array(sides), list(shingle_sets(list(texts))))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for m, g, p, q, side, node, label, text in rows_of(batch, "mixed", "group", "p", "q", "side", "node", "label", "text"):
            if (m, g, p, q) != group:
                yield found()
                group = (m, g, p, q)
            held[node] = (side, label, text)
    yield found()


def tree_links(members: DataFrame, texts: DataFrame, whole: bool) -> DataFrame:
    """a, b: edges between the labels of sets that link and have a common group. members: group, node, n, label.

    Small groups are put together by hash until they fill a tree, whose bounds part what has nothing in common. A larger
    group's sets are dealt to trees of bounded size. Only the sets of one tree meet if not `whole`; else every two trees
    of a group do. Either way a task's edges are fewer than its sets.
    """
    members = staged(members, "members")
    size = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    share = 1 if whole else FIRST_SHARE
    size = size.select("group", "sets", "shingles", F.greatest(F.ceil(share * F.col("sets") / TREE), F.ceil(share * F.col("shingles") / TREE_SHINGLES)).cast("int").alias("trees"))
    sets, shingles = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    lots = max(1, sets // TOGETHER, shingles // TOGETHER_SHINGLES)
    small = (F.col("sets") <= TOGETHER // 8) & (F.col("shingles") <= TOGETHER_SHINGLES // 8)
    lot = F.when(small & (F.col("trees") <= 1), F.pmod(F.xxhash64("group"), F.lit(lots)))
    rows = members.join(size.withColumn("lot", lot), "group")
    apart = rows.filter("lot IS NULL").withColumn("part", F.pmod(F.xxhash64("node", "group"), F.col("trees")).cast("int"))
    apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)) if whole else F.col("part"))
    apart = apart.select(F.lit(False).alias("mixed"), "group", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "label")
    mixed = rows.filter("lot IS NOT NULL").select(F.lit(True).alias("mixed"), F.col("lot").alias("group"), *(F.lit(0).alias(c) for c in ("p", "q", "part")), "node", "label").distinct()
    rows = apart.unionByName(mixed).join(texts, "node").withColumn("side", (F.col("part") != F.col("p")).cast("int")).drop("part")
    keys = ["mixed", "group", "p", "q"]
    edges = staged(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_search, "a long, b long").distinct(), "links")
    discard(members)
    return edges


def first_groups(sets: DataFrame) -> DataFrame:
    """Each set under its first keys, where near copies mostly meet."""
    return sets.select(F.explode(F.slice(F.array_sort("keys"), 1, FIRST_KEYS)).alias("group"), "node", "n", F.col("node").alias("label"))


def split_groups(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups in which every two sets of different components meet that may link.

    Such sets share least_shared() keys, all of them with several components. A set with fewer of them is done; of c
    it needs the first c - least_shared() + 1 in a common order, the rarest first. Keys with the same smallest label
    have mostly the same sets and make one group.
    """
    sets = staged(sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    rows = sets.select("node", "n", "label", F.explode("keys").alias("key"))
    keys = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("times")).filter("lo <> hi")
    left = rows.join(keys.select("key", "lo", "times"), "key").groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("times", "key", "lo"))).alias("own"))
    left = left.withColumn("spare", F.size("own") - least_shared("n")).filter("spare >= 0")
    return left.select(F.explode(F.array_distinct(F.expr("slice(own, 1, CAST(spare AS INT) + 1).lo"))).alias("group"), "node", "n", "label")


def components(edges: DataFrame) -> DataFrame:
    """node, label for the ends of edges a, b; the label is the smallest node of the component.

    Each round a node takes the smallest label among its own and its neighbours', and then that label's label.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        found = staged(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        discard(labels)
        labels, changed = found, not found.filter("old <> label").isEmpty()
        if not changed:
            discard(both)
            return labels.select("node", "label")


def near_duplicates(docs: DataFrame, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    1. Equal sets become one node. A set's keys are its first shingles in order of hash, so many that sets that link
       share a certain number of keys, not just one. A set that shares fewer with all others together links with
       none: most sets of a corpus end here.
    2. The others are joined by signature trees under two of their keys each, which connects groups of copies.
    3. Keys whose sets are still in different components are searched whole by signature trees. Each tree compares
       what its bounds leave over shingle by shingle and yields only edges that join components, so a group of
       copies costs in proportion to its size, and no pair is written but those.

    A group with more sets than a tree holds, all different and still of different components after step 2, is dealt
    to all pairs of its trees: its texts are shipped as often as it has trees, its output stays in proportion.

    Null and empty texts have no shingles and link with nothing. A row with a null id takes part by its text.
    Repeated rows share their component; if rows of one id differ, each text is a set of its own. An
    empty table gives no rows. Extra columns are ignored.
    """
    key, text = columns
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("ref", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).select("doc_id", "ref", "text")
    keyed = staged(keyed_sets(docs), "keyed-sets")
    sets = staged(docs.mapInArrow(_sets, "doc_id long, ref long, node long, n int"), "sets")
    # each node with the smallest id that has its set; only those without any go by the hash of the text
    reps = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.min("ref").alias("doc_ref"))
    reps = staged(reps.withColumn("doc_ref", F.when(F.col("doc").isNull(), F.col("doc_ref"))), "reps")
    needed = keyed.select("node").join(reps, "node")
    same = docs["doc_id"].eqNullSafe(needed["doc"]) & docs["ref"].eqNullSafe(needed["doc_ref"])
    texts = staged(docs.join(needed, same).select("node", "text").mapInArrow(_own_texts, "node long, text string"), "keyed-texts")
    near = tree_links(first_groups(keyed), texts, whole=False)
    labels = components(near)
    rest = tree_links(split_groups(keyed, labels), texts, whole=True)
    labels = components(near.unionByName(rest))
    discard(keyed, texts, near, rest)
    whole = reps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = whole.groupBy("label").agg(F.min("doc").alias("component_id"))
    of = whole.join(smallest, "label").select("node", "component_id")
    out = sets.select("doc_id", "node", "n").join(of, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
