"""Sum-of-squares packing of token sequences into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import byte_level_encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n.split()[0], pa.int64()) for n in SCHEMA.split(", ")])
#: Open windows a task holds at most, 4 * window bytes each; beyond them the fullest is filled up from the emptiest.
MAX_OPEN = 4096


class SumOfSquares:
    """Online packing of pieces into windows by the sum-of-squares rule.

    level[h] counts the open windows filled to h. A piece of s ids goes to the level h (0: a new window) where
    moving one window from h to h + s leaves the smallest sum of squared counts; ties go to the fullest window.
    Pieces are shorter than a window. Windows that come to `window` are closed and given to `emit`.
    """

    def __init__(self, window: int, emit):
        self.window, self.emit = window, emit
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.bins: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = 0

    def place(self, piece: tuple, size: int) -> None:
        w, n = self.window, self.level
        # twice the counts' growth for every level h that leaves room: 2 (n[h + s] - n[h]) + 2, and one less
        # where the window is new (h = 0) or is closed (h + s = window), as n[0] = n[window] = 0
        growth = 2 * (n[size:] - n[: w + 1 - size]) + 2
        growth[0] -= 1
        growth[-1] -= 1
        growth[1:][n[1 : w + 1 - size] == 0] = np.iinfo(np.int64).max
        h = w - size - int(np.argmin(growth[::-1]))
        held = self._taken(h) if h else []
        held.append(piece)
        if h + size == w:
            self.emit(held)
        else:
            self._put(held, h + size)

    def settle(self, most: int) -> None:
        """Fills the fullest open windows with ids from the emptiest, cutting pieces, until `most` are open.

        So the windows that the rule has filled best keep all their pieces. If none may stay open, windows filled to
        a power of two, which need no padding, close as they are, and so does the last in parts of powers of two.
        """
        if not most:
            for h in (1 << b for b in range(self.window.bit_length()) if 1 << b < self.window):
                while self.bins[h]:
                    self.emit(self._taken(h))
        while self.open > most:
            h = int(np.flatnonzero(self.level)[-1])
            held = self._taken(h)
            while h < self.window and self.open:
                low = int(np.flatnonzero(self.level)[0])
                donor, left = self._taken(low), low
                while donor and h < self.window:
                    doc, start, ids, n = donor.pop()
                    size = min(len(ids), self.window - h)
                    held.append((doc, start + len(ids) - size, ids[len(ids) - size :], n))
                    if size < len(ids):
                        donor.append((doc, start, ids[: len(ids) - size], n))
                    h, left = h + size, left - size
                if donor:
                    self._put(donor, left)
            if h == self.window:
                self.emit(held)
            else:
                self._emit_in_parts(held, h)

    def _taken(self, h: int) -> list[tuple]:
        self.level[h] -= 1
        self.open -= 1
        return self.bins[h].pop()

    def _put(self, held: list[tuple], h: int) -> None:
        self.bins[h].append(held)
        self.level[h] += 1
        self.open += 1

    def _emit_in_parts(self, pieces: list[tuple], total: int) -> None:
        rest = list(reversed(pieces))
        for room in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
            held = []
            while room:
                doc, start, ids, n = rest.pop()
                if len(ids) > room:
                    rest.append((doc, start + room, ids[room:], n))
                    ids = ids[:room]
                held.append((doc, start, ids, n))
                room -= len(ids)
            self.emit(held)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """Packs every document into windows of at most `window` ids; one output row per piece.

    A document's ids are the tokenizer's and then `end_id`. Whole windows of a long document stand alone; what
    remains is placed by SumOfSquares, separately in each task, so nothing is shuffled and a task that is run
    again gives the same rows. Of the windows still open at a task's end the fuller are filled up from the emptier.
    `sequence_id` is the task's number times 2**40 and a count.

    Null text counts as empty: one piece with `end_id` alone. Null or repeated ids are kept, each row is packed on
    its own. An empty table gives no rows. Extra columns are ignored. Very long texts are cut into windows.
    """
    key, text = columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(tokenizer)
        out: list[tuple] = []
        taken = TaskContext.get().partitionId() << 40

        def emit(held: list[tuple]) -> None:
            nonlocal taken
            at = 0
            for doc, start, ids, n in held:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, taken, at))
                at += len(ids)
            taken += 1

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=_ARROW)

        packer = SumOfSquares(window, emit)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc in enumerate(ids_of):
                ids = np.append(encode(texts[i].as_py() or ""), np.uint32(end_id))
                whole = len(ids) // window * window
                for at in range(0, whole, window):
                    emit([(doc, at, ids[at : at + window], len(ids))])
                if whole < len(ids):
                    packer.place((doc, whole, ids[whole:].copy(), len(ids)), len(ids) - whole)
                packer.settle(MAX_OPEN)
            yield flush()
        packer.settle(0)
        yield flush()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(pack, SCHEMA)
