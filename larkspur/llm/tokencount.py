"""Token counts from distinct pre-tokens, without materialising ids."""

from __future__ import annotations

import functools
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import library_tokenizer

_FREQ = "block long, piece string, pairs binary, salt int"
_PART = "block long, docs binary, sums binary, listing boolean"
_PAIR = np.dtype([("doc", "<u4"), ("freq", "<u4")])
#: Blocks whose sums a counting task holds before it hands them on.
OPEN_BLOCKS = 512
#: A pre-token in more than this share of a block's documents is dealt to SALTS tasks, by block.
HOT_SHARE, SALTS = 0.05, 1024


@functools.lru_cache(maxsize=4)
def _splitter(path: str):
    """text -> its pre-tokens, special strings included as pre-tokens of their own."""
    import public_tokenizers
    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level tokenizer")
    find = regex.compile(public_tokenizers.PATTERN).findall
    special = [a["content"] for a in spec.get("added_tokens", [])]
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

    def split(text: str) -> list[str]:
        if cut is None or not any(s in text for s in special):
            return find(text)
        return [w for i, part in enumerate(cut(text)) for w in ([part] if i % 2 else find(part))]

    return split


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    1. Each Arrow batch of documents is a block. A task splits its texts into pre-tokens and writes, for each
       distinct pre-token of the block, the documents that hold it and how often.
    2. The rows are dealt by pre-token, so each distinct pre-token of the corpus meets in one task and goes to
       the tokenizers library once; its piece count joins the frequencies, which are summed by block at once.
       A frequent pre-token has one row a block, and its blocks are dealt to SALTS tasks, each of which counts it once.
    3. The partial sums meet by block, and each block's documents get their totals.

    Null and empty texts have 0 bytes and 0 tokens. Repeated and null ids are kept as rows of their own. An
    empty table gives no rows. Extra columns are ignored. Texts of any length are counted whole. A tokenizer that
    isn't plain byte-level BPE raises ValueError: its pre-tokens are not what its pieces are made of.
    """
    key, text = columns

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, names = _splitter(tokenizer), [f.split()[0] for f in _FREQ.split(", ")]
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            number: defaultdict[str, int] = defaultdict()
            number.default_factory = number.__len__
            coded = []
            for t in batch.column(2):
                words = split(t.as_py() or "")
                coded.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            uniques, codes = list(number), np.concatenate(coded)
            pair = codes * n + np.repeat(np.arange(n), [len(c) for c in coded])
            pair.sort()
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            pairs = np.empty(len(first), _PAIR)
            pairs["doc"], pairs["freq"] = pair[first] % n, np.diff(first, append=len(pair))
            at = np.searchsorted(pair[first] // n, np.arange(len(uniques) + 1)).astype(np.int32)
            # the offsets cut one buffer of pairs by pre-token
            binary = pa.Array.from_buffers(pa.binary(), len(uniques), [None, pa.py_buffer(at * np.int32(_PAIR.itemsize)), pa.py_buffer(pairs.tobytes())])
            salt = np.where(np.diff(at) > HOT_SHARE * n, (block * 0x9E3779B97F4A7C15 >> 40) % SALTS, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uniques), block)), pa.array(uniques, pa.string()), binary, pa.array(salt)], names=names)
            # a row without a pre-token lists the block's documents: ids, which may be null, and bytes
            listing = json.dumps([batch.column(c).to_pylist() for c in (0, 1)]).encode()
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.string()), pa.array([listing], pa.binary()), pa.array([0], pa.int32())], names=names)
            block += 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by the hash of the pre-token: the count of a run is taken once. Sums by block are kept and handed on in lots."""
        encode = library_tokenizer(tokenizer).encode_batch
        last, pieces = None, 0
        sums: dict[int, np.ndarray] = {}
        names = [f.split()[0] for f in _PART.split(", ")]

        def handed() -> pa.RecordBatch:
            held = [(b, np.flatnonzero(s).astype("<u4"), s) for b, s in sums.items()]
            cols = [pa.array([b for b, _, _ in held], pa.int64()), pa.array([i.tobytes() for _, i, _ in held], pa.binary()), pa.array([s[i].astype("<u8").tobytes() for _, i, s in held], pa.binary()), pa.array([False] * len(held))]
            sums.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            words = batch.column(1)
            named = words.is_valid().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(named)
            if len(rows) < len(named):
                listed = batch.filter(pa.array(~named))
                yield pa.RecordBatch.from_arrays([listed.column(0), listed.column(2), pa.nulls(len(listed), pa.binary()), pa.array([True] * len(listed))], names=names)
            if not len(rows):
                continue
            kept = batch.filter(pa.array(named))
            own = np.array(kept.column(1).to_pylist(), dtype=object)
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            known = int(own[0] == last)
            fresh = [len(e.ids) for e in encode(list(own[starts[known:]]), add_special_tokens=False)]
            each = np.array([pieces] * known + fresh, dtype=np.int64)
            last, pieces = own[-1], int(each[-1])
            per_row = np.repeat(each, np.diff(starts, append=len(own)))
            blocks = kept.column(0).to_numpy()
            packed = kept.column(2)
            ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // _PAIR.itemsize
            lengths, pairs = np.diff(ends), np.frombuffer(packed.buffers()[2], _PAIR, count=int(ends[-1]))[ends[0] :]
            doc, gain = pairs["doc"], pairs["freq"] * np.repeat(per_row, lengths)
            of = np.repeat(blocks, lengths)
            order = np.argsort(of, kind="stable")
            of, doc, gain = of[order], doc[order], gain[order]
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            for a, z in zip(cuts, [*cuts[1:], len(of)], strict=True):
                got = np.bincount(doc[a:z], weights=gain[a:z]).astype(np.int64)
                s = sums.get(of[a])
                if s is None or len(s) < len(got):
                    sums[of[a]] = got if s is None else got + np.pad(s, (0, len(got) - len(s)))
                else:
                    s[: len(got)] += got
            if len(sums) > OPEN_BLOCKS:
                yield handed()
        yield handed()

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, the row with the document ids first."""
        ids, size, total, of = [], [], np.empty(0, np.int64), None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for batch in batches:
            for b, docs, sums, listing in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if listing:
                    yield out()
                    (ids, size), of = json.loads(docs), b
                    total = np.zeros(len(ids), np.int64)
                elif b == of:
                    total[np.frombuffer(docs, "<u4")] += np.frombuffer(sums, "<u8").astype(np.int64)
        yield out()

    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    rows = texts.mapInArrow(frequencies, _FREQ)
    dealt = rows.repartition(F.coalesce("piece", F.col("block").cast("string")), "salt").sortWithinPartitions("piece")
    parts = dealt.select("block", "piece", "pairs").mapInArrow(counted, _PART).repartition("block").sortWithinPartitions("block", F.desc("listing"))
    return parts.mapInArrow(totals, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
