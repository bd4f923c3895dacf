"""What the operators of this subpackage share: table access and tokenizer loading, and the staged tables of larkspur.plans."""

from __future__ import annotations

import ctypes
import functools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.staging import discard, held, staged, staged_path

__all__ = ["bounded_batches", "byte_level_encoder", "discard", "giving_back", "held", "library_tokenizer", "rows_of", "staged", "staged_path", "table", "tokenizer_path"]


#: Bytes of a batch of rows that goes to a Python worker, about; the rows themselves are whole.
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES for the session's Python stages, unless the session asks for others.

    A task holds a batch several times over, in the JVM, on its way and in the worker, so long texts make Spark's own
    64 MB a large part of an executor.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work on batches; at its end the worker, which Spark keeps for later tasks, returns the memory it no longer needs."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # glibc alone has it
                trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _unicode_to_byte() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def library_tokenizer(path: str, special: bool = True):
    """The tokenizers library's own reader of the file, without padding or truncation; with special=False special strings inside texts are plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    if not special:
        t.encode_special_tokens = True
    return t


@functools.lru_cache(maxsize=4)
def byte_level_encoder(path: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """text -> ids as the tokenizers library gives them for a byte-level BPE .json file, no special tokens added.

    Where the file is plain byte-level BPE whose merge order is its id order, the same merges run in tiktoken,
    which gives the same ids at about five times the speed; any other file goes to the tokenizers library.
    Special strings inside a text become their single id, as is the library's default, or with special=False are plain text.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, back = model.get("vocab", {}), _unicode_to_byte()
    added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
    plain = (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not spec.get("normalizer")
        and all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) for a in spec.get("added_tokens", []))
    )
    if plain:
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocab[j] for j in joined]
        plain = ids == sorted(ids) and len(set(ids)) == len(ids) and all(min(ids, default=256) > vocab[c] for c in back if c in vocab)

    def slow(text: str) -> np.ndarray:
        # read when first needed: a worker that needs the fast one alone holds no second vocabulary
        return np.asarray(library_tokenizer(path, special).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if not plain:
        return slow

    import public_tokenizers
    import tiktoken

    ranks = {bytes(back[c] for c in word): i for word, i in vocab.items() if word not in added}
    fast = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint32)
        if special and any(s in text for s in added):
            return slow(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def rows_of(batch, *names: str) -> Iterator[tuple]:
    """The rows of an Arrow batch as tuples of Python values."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)
