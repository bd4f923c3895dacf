"""Alignment of two tokenizers' tokens, with counts of linked pairs by external runs that are merged."""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import _unicode_to_byte, byte_level_encoder, staged

#: Bytes of text in a block, whose records are sorted in memory.
BLOCK_BYTES = 1 << 22
#: Bits of the B id that part the records, pairs in a frame of a run, and bytes of runs that one task merges, at most about.
RADIX_BITS, FRAME, SLICE_BYTES = 6, 4096, 1 << 25
#: Blocks whose sums a task holds before it hands them on.
OPEN_BLOCKS = 256

_RUN = "block long, radix int, totals array<binary>, records binary, docs binary"
_ROW = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_SUMS = "block long, docs binary, best binary, sums binary"


@dataclass
class Side:
    """One tokenizer: its encoder, and of every id the bytes and how many they are."""

    encode: object
    entries: list[bytes]
    lengths: np.ndarray

    @classmethod
    def of(cls, encode: object, entries: list[bytes]) -> Side:
        return cls(encode, entries, np.array([len(e) for e in entries], np.int64))

    def covers(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the ids' bytes, joined, are raw."""
        return int(self.lengths[ids].sum()) == len(raw) and b"".join(map(self.entries.__getitem__, ids.tolist())) == raw


@functools.lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """A byte-level BPE file, whose entries are spelt in stand-ins for bytes; special strings are plain text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back, vocab = _unicode_to_byte(), spec["model"]["vocab"]
    added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    entries = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for word, i in vocab.items():
        entries[i] = word.encode() if word in added else bytes(map(back.__getitem__, word))
    return Side.of(byte_level_encoder(path, special=False), entries)


@functools.lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A sentencepiece model: U+2581 stands for a space, <0xHH> for a byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    entries = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    return Side.of(lambda text: np.array(model.encode(text, num_threads=1), np.int64), entries)


@functools.lru_cache(maxsize=4)
def _shown(ids: int, mark: str) -> np.ndarray:
    return np.array([f"{i}{mark}" for i in range(ids)], dtype=f"S{len(str(ids)) + 1}")


@dataclass
class Aligned:
    """The tokens of one text, and which of them end together."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray

    @classmethod
    def of(cls, text: str | None, left: Side, right: Side) -> Aligned | None:
        """None for texts without tokens: null, empty, or not spelt by both sides' tokens."""
        if not text:
            return None
        spaced = " " + text
        raw = spaced.encode()
        a, b = left.encode(spaced).astype(np.int64), right.encode(text)
        if not (len(b) and left.covers(a, raw) and right.covers(b, raw)):
            return None
        a_ends, b_ends = np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b])
        # both end with the text, so every place of one lies among the other's
        at = np.searchsorted(b_ends, a_ends)
        a_at = np.flatnonzero(b_ends[at] == a_ends)
        return cls(a, b, a_at, at[a_at])

    def groups(self, ids: int) -> bytes:
        """a1,a2|b1;a3|b2,b3: the ids of every group in order; all of them are below `ids`."""
        comma, bar, end = (_shown(ids, m) for m in ",|;")
        out = np.empty(len(self.a) + len(self.b), comma.dtype)
        # a token comes after those before it on its side and the other side's of the groups before its own
        a_place = np.arange(len(self.a)) + np.repeat(np.append(0, self.b_at[:-1] + 1), np.diff(self.a_at, prepend=-1))
        b_place = np.arange(len(self.b)) + np.repeat(self.a_at + 1, np.diff(self.b_at, prepend=-1))
        out[a_place], out[b_place] = comma[self.a], comma[self.b]
        out[a_place[self.a_at]], out[b_place[self.b_at]] = bar[self.a[self.a_at]], end[self.b[self.b_at]]
        return out.tobytes().translate(None, b"\0")[:-1]


@dataclass
class Keys:
    """A pair as one number: the low bits of the B id, which part the records, then the rest of it, then the A id."""

    a_bits: int
    b_bits: int

    @classmethod
    def of(cls, left: Side, right: Side) -> Keys:
        return cls((len(left.entries) - 1).bit_length(), max(RADIX_BITS, (len(right.entries) - 1).bit_length()))

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((b & (1 << RADIX_BITS) - 1) << (self.b_bits - RADIX_BITS) | b >> RADIX_BITS) << self.a_bits | a

    def radix(self, key: np.ndarray) -> np.ndarray:
        return key >> (self.a_bits + self.b_bits - RADIX_BITS)


def _pressed(*parts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(p.tobytes() for p in parts))


def _unpressed(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<u4", len(kinds)), 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _frames(key: np.ndarray, total: np.ndarray) -> list[bytes]:
    """A run: frames of ascending keys, as gaps, with their totals."""
    return [_pressed(np.diff(key[i : i + FRAME], prepend=0).astype("<u8"), total[i : i + FRAME].astype("<u8")) for i in range(0, len(key), FRAME)]


def _unframed(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, total = _unpressed(frame, "<u8", "<u8")
    return np.cumsum(gaps).astype(np.int64), total.astype(np.int64)


def _read(frames: Iterable[bytes]) -> Iterator[tuple[int, int]]:
    for frame in frames:
        key, total = _unframed(frame)
        yield from zip(key.tolist(), total.tolist(), strict=True)


def merged_runs(runs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and the sums of their totals: a k-way merge of runs by a heap, one frame of each unpacked at a time."""
    keys, sums, last = array("q"), array("q"), -1
    for key, total in heapq.merge(*map(_read, runs)):
        if key == last:
            sums[-1] += total
        else:
            keys.append(key)
            sums.append(total)
            last = key
    return np.frombuffer(keys, np.int64) if keys else np.empty(0, np.int64), np.frombuffer(sums, np.int64) if sums else np.empty(0, np.int64)


def _highest(key: np.ndarray, count: np.ndarray, a_bits: int) -> np.ndarray:
    """Which keys have the highest count of their B id; in side-major order those of one id stand together."""
    side = key >> a_bits
    starts = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
    return count == np.repeat(np.maximum.reduceat(count, starts), np.diff(starts, append=len(key)))


def align_tokens(docs: DataFrame, byte_bpe: str, pieces: str, columns: tuple[str, str] = ("doc_id", "text"), keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of docs; with keep_groups also groups, the text that is hashed.

    1. A task encodes its texts by both tokenizers, links tokens that end at the same byte, and sorts the links of each
       block of texts by pair and document. A block's records are parted by the low bits of the B id into zstd runs: of
       each pair its total in the block, and the documents that hold it.
    2. The totals meet by radix, dealt to as many tasks as their bytes take, and are merged by a heap; the results meet
       again by radix. Pairs come out ordered by B id, so each id's highest count is known once its pairs have passed.
    3. The runs meet their radix's counts, dealt as before, and stream back every document's sums, which meet by block.

    What a task holds is bounded by SLICE_BYTES of compressed runs and one radix's distinct pairs, whatever a pair's count.

    Null and empty texts, and texts whose joined bytes differ from space + text on either side, have zeros and an empty
    digest. Repeated and null ids are rows of their own. Texts of any length are taken whole. An empty table gives no
    rows. Extra columns are ignored, whatever their names.
    """
    doc_id, text = (F.col(f"`{c}`") for c in columns)
    listed = [*_ROW, "groups"] if keep_groups else [*_ROW]

    def sides() -> tuple[Side, Side, Keys]:
        left, right = byte_side(byte_bpe), piece_side(pieces)
        return left, right, Keys.of(left, right)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, keys = sides()
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            lot = np.cumsum(sizes) // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), len(lot)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    yield block(next(number), batch.slice(lo, hi - lo), left, right, keys)

    def block(number: int, rows: pa.RecordBatch, left: Side, right: Side, keys: Keys) -> pa.RecordBatch:
        doc_bits = rows.num_rows.bit_length()
        if keys.a_bits + keys.b_bits + doc_bits > 62:
            raise ValueError("vocabularies are too large for keys of 64 bits")
        facts, links = [], []
        for doc, t in enumerate(rows.column(1)):
            own = Aligned.of(t.as_py(), left, right)
            if own is None:
                facts.append((0, 0, 0, 0, "", ""))
                continue
            groups = own.groups(max(len(left.entries), len(right.entries)))
            facts.append((len(own.a), len(own.b), len(own.a_at), len(own.a_at), hashlib.sha256(groups).hexdigest(), groups.decode() if keep_groups else None))
            links.append(keys.key(own.a[own.a_at], own.b[own.b_at]) << doc_bits | doc)
        columns = [rows.column(0), *(pa.array([f[i] for f in facts], pa.int64()) for i in range(4)), *(pa.array([f[i] for f in facts], pa.string()) for i in ((4, 5) if keep_groups else (4,)))]
        listing = pa.RecordBatch.from_arrays(columns, names=listed)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, listing.schema) as w:
            w.write_batch(listing)
        out = [(number, -1, None, None, sink.getvalue().to_pybytes())]
        record, freq = np.unique(np.concatenate(links), return_counts=True) if links else (np.empty(0, np.int64),) * 2
        key, doc = record >> doc_bits, record & (1 << doc_bits) - 1
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        pair, total, holders = key[starts], np.add.reduceat(freq, starts) if len(starts) else freq, np.diff(starts, append=len(key))
        cuts = np.searchsorted(keys.radix(pair), np.arange((1 << RADIX_BITS) + 1))
        ends = np.append(starts, len(key))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            p, d = slice(cuts[r], cuts[r + 1]), slice(ends[cuts[r]], ends[cuts[r + 1]])
            out.append((number, r, _frames(pair[p], total[p]), _pressed(holders[p].astype("<u4"), doc[d].astype("<u4"), freq[d].astype("<u4")), None))
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=[f.split()[0] for f in _RUN.split(", ")])

    def groups_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[dict]]]:
        """Rows sorted by their first columns, one group at a time."""
        rows = (tuple(r.values()) for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
        return itertools.groupby(rows, key=lambda r: r[:width])

    def counted(width: int, last: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a_bits = sides()[2].a_bits if last else 0
            for (radix, *_), rows in groups_of(batches, width):
                key, count = merged_runs([r[-1] for r in rows])
                # the lowest bit of a final count tells whether it is its B id's highest
                frames = _frames(key, count << 1 | _highest(key, count, a_bits) if last else count)
                yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([frames], pa.list_(pa.binary()))], names=["radix", "totals"])

        return of

    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (radix, slice, block, totals, records): a radix's counts, which have no block, then its runs."""
        open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def handed() -> pa.RecordBatch:
            held = [(b, np.flatnonzero(s), n, s) for b, (n, s) in open_.items()]  # a linked document's sum is never 0
            cols = [pa.array([b for b, *_ in held], pa.int64()), *(pa.array(x, pa.binary()) for x in ([at.astype("<u4").tobytes() for _, at, _, _ in held], [n[at].astype("<u8").tobytes() for _, at, n, _ in held], [s[at].astype("<u8").tobytes() for _, at, _, s in held]))]
            open_.clear()
            return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in _SUMS.split(", ")])

        for _, rows in groups_of(batches, 2):
            known = count = high = None
            for _, _, number, totals, records in rows:
                parts = [_unframed(f) for f in totals]
                key, total = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                if number is None:
                    known, count, high = key, total >> 1, total & 1
                    continue
                holders, doc, freq = _unpressed(records, "<u4", "<u4", "<u4")
                at = np.repeat(np.searchsorted(known, key), holders)
                n = int(doc.max()) + 1
                best, sums = open_.get(number, (np.empty(0, np.int64),) * 2)
                if len(sums) < n:
                    best, sums = np.pad(best, (0, n - len(best))), np.pad(sums, (0, n - len(sums)))
                np.add.at(best, doc, freq * high[at])
                np.add.at(sums, doc, freq * count[at])
                open_[number] = best, sums
                if len(open_) > OPEN_BLOCKS:
                    yield handed()
        yield handed()

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, each block's documents first."""
        for _, rows in groups_of(batches, 1):
            for _, listing, at, n, s in rows:
                if listing is not None:
                    own = pa.ipc.open_stream(listing).read_all().combine_chunks()
                    best, sums = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                else:
                    at = np.frombuffer(at, "<u4")
                    best[at] += np.frombuffer(n, "<i8")
                    sums[at] += np.frombuffer(s, "<i8")
            full = own.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(sums)).select(names)
            yield from full.to_batches()

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *listed[5:]]
    pair_runs = staged(docs.select(doc_id.cast("long").alias("doc_id"), text.alias("text")).mapInArrow(runs, _RUN), "pair-runs")
    held = pair_runs.filter("radix >= 0")
    size = held.groupBy("radix").agg(F.sum(F.aggregate("totals", F.octet_length("records").cast("long"), lambda n, f: n + F.octet_length(f))).alias("bytes"))
    slices = staged(size.select("radix", F.ceil(F.col("bytes") / SLICE_BYTES).cast("int").alias("slices")), "slices")  # a row a radix
    dealt = held.join(F.broadcast(slices), "radix").withColumn("slice", F.pmod(F.xxhash64("block"), F.col("slices")).cast("int"))
    parts = dealt.select("radix", "slice", "totals").repartition("radix", "slice").sortWithinPartitions("radix", "slice").mapInArrow(counted(2, False), "radix int, totals array<binary>")
    counts = staged(parts.repartition("radix").sortWithinPartitions("radix").mapInArrow(counted(1, True), "radix int, totals array<binary>"), "pair-counts")
    spread = counts.join(F.broadcast(slices), "radix").select("radix", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("block"), "totals", F.lit(None).cast("binary").alias("records"))
    met = dealt.select("radix", "slice", "block", "totals", "records").unionByName(spread).repartition("radix", "slice").sortWithinPartitions("radix", "slice", F.col("block").asc_nulls_first())
    sums = met.mapInArrow(returned, _SUMS)
    blank = F.lit(None).cast("binary")
    listings = pair_runs.filter("radix < 0").select("block", F.col("docs").alias("listing"), blank.alias("docs"), blank.alias("best"), blank.alias("sums"))
    back = listings.unionByName(sums.select("block", blank.alias("listing"), "docs", "best", "sums")).repartition("block").sortWithinPartitions("block", F.col("listing").isNull())
    return back.mapInArrow(finished, ", ".join(f"{n} {'string' if n in ('groups_sha256', 'groups') else 'long'}" for n in names))
