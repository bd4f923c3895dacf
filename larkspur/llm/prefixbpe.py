"""BPE by dynamic programming over prefixes: suffix automaton matches and pair tests give the last token of every prefix."""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import _unicode_to_byte, library_tokenizer

#: Bytes of ids that are handed on together.
LOT_BYTES = 1 << 22
#: Words and runs between white space that a task remembers, and characters of one at most. Others are worked out again.
WORDS, RUNS, REMEMBERED_CHARS = 1 << 19, 1 << 17, 24
#: Pairs of tokens whose test is remembered.
PAIRS = 1 << 19
#: Characters that lower-casing, composition and classes treat alike in every version of Unicode and one by one; texts with others are normalised by the library.
_USUAL = "\x00-\x1b -ɏЀ-џ‐-‧ぁ-ゖァ-ヺ一-龥"
#: What the file must say for its words to be found here. Fixed values, as the file has them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class SuffixAutomaton:
    """All substrings of a vocabulary's entries. Reading a text leads to the longest of them that ends at each place.

    A state's links lead to ever shorter suffixes, so the entries that end at a place lie on them; an entry is always the
    longest string of its state.
    """

    def __init__(self, entries: dict[int, tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.entry = [-1], [0], [-1]
        for token, symbols in entries.items():
            at = 0
            for c in symbols:
                at = self._grown(at, c)
            self.entry[at] = token
        self.ends: list[tuple | None] = [None] * len(self.link)

    def entries_at(self, state: int) -> tuple[tuple[int, int], ...]:
        """Length and entry of all that may end where this state was reached, the longest first."""
        if self.ends[state] is None:
            own = ((self.length[state], self.entry[state]),) if self.entry[state] >= 0 else ()
            self.ends[state] = own + (self.entries_at(self.link[state]) if state else ())
        return self.ends[state]

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.entry.append(-1)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The strings of q that p + c ends get a state of their own."""
        own = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = own
            p = self.link[p]
        return own

    def _grown(self, p: int, c: int) -> int:
        q = self.next[p].get(c)
        if q is not None:
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        own = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = own
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[own] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return own


class PrefixBpe:
    """Exact BPE of words over symbols, whose merges rank as their ids.

    Each merge makes one id of its own, larger than its parts'. Then the ids of a text are the only ones in which every two
    neighbours are the ids of their own joined text, and those of a prefix are a prefix of them but for the last token.
    """

    def __init__(self, merges: list[tuple[int, int, int]], symbols: list[int]):
        """merges: left, right and made id, by rank; symbols: the ids that no merge makes."""
        self.merged = {(a, b): c for a, b, c in merges}
        self.parts = {c: (a, b) for a, b, c in merges}
        made = [c for _, _, c in merges]
        if made != sorted(set(made)) or any(max(a, b) >= c for a, b, c in merges):
            raise ValueError("the merges' ids don't rise, or a merge has no id of its own")
        if made and max(symbols) >= made[0]:
            raise ValueError("a symbol's id lies among those of the merges")
        entries = {x: (x,) for x in symbols}
        for a, b, c in merges:
            entries[c] = entries[a] + entries[b]
        self.automaton = SuffixAutomaton(entries)
        self.known: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a: undoing the merges of both from the last, no pair at the boundary would have merged before them."""
        if len(self.known) >= PAIRS:
            self.known.clear()
        found = self.known[a << 32 | b] = self._fits(a, b)
        return found

    def _fits(self, x: int, y: int) -> bool:
        # ids rank the merges: x is there until the merge x_end takes it up, y until y_end
        x_end = y_end = 1 << 62
        while True:
            both = self.merged.get((x, y))
            # of equal merges the left one comes first
            if both is not None and both < x_end and both <= y_end:
                return False
            if x > y and x in self.parts:
                x_end, x = x, self.parts[x][1]
            elif y in self.parts:
                y_end, y = y, self.parts[y][0]
            elif x in self.parts:
                x_end, x = x, self.parts[x][1]
            else:
                return True

    def encode(self, symbols: list[int]) -> list[int]:
        """The ids of one word."""
        follow, link, length, ends, known = self.automaton.next, self.automaton.link, self.automaton.length, self.automaton.ends, self.known
        last: list[int] = []  # of every prefix, with its length
        sizes: list[int] = []
        at = size = end = 0
        for c in symbols:
            end += 1
            to = follow[at].get(c)
            while to is None:
                if not at:
                    raise ValueError("a symbol isn't in the vocabulary")
                at = link[at]
                size = length[at]
                to = follow[at].get(c)
            at = to
            size += 1
            for n, token in ends[at] or self.automaton.entries_at(at):
                if n > size:
                    continue
                if n == end:
                    break
                before = last[end - n - 1]
                fit = known.get(before << 32 | token)
                if self.fits(before, token) if fit is None else fit:
                    break
            last.append(token)
            sizes.append(n)
        out = []
        while end:
            out.append(last[end - 1])
            end -= sizes[end - 1]
        return out[::-1]


class WordEndTokenizer:
    """A file of BPE with word ends: texts lower-cased and cut into words, white space dropped."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
        split, level = pre[0], pre[-1]
        own = (
            len(pre) == 2 and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
            and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
            and spec.get("normalizer") == _NORMALIZER and not spec.get("decoder") and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>"
            and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and not any(a[x] for a in spec.get("added_tokens", []) for x in ("lstrip", "rstrip", "single_word", "normalized"))
        )
        if not own:
            raise ValueError(f"{path} is not a lower-casing BPE file with word ends and no decoder")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        shown = {b: c for c, b in _unicode_to_byte().items()}
        self.inner, self.final = ([vocab[shown[b] + e] for b in range(256)] for e in ("", end))
        self.bpe = PrefixBpe([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], [*self.inner, *self.final])
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.names = {i: w for w, i in [*vocab.items(), *self.added.items()]}
        self.library = library_tokenizer(path)
        self.back = _unicode_to_byte()
        self.find = regex.compile(_SPLIT.replace(r"\s", r"\t-\r \x85\xa0")).findall
        self.unusual = regex.compile(f"[^{_USUAL}]").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda t: [t]
        self.words: dict[str, tuple[bytes, str]] = {}
        #: Ids and decoded text of runs between white space; the other part of the text is put together from them.
        self.runs: tuple[dict[str, bytes], dict[str, str]] = {}, {}

    def _word(self, word: str) -> tuple[bytes, str]:
        found = self.words.get(word)
        if found is None:
            raw = word.encode()
            found = self._told(self.bpe.encode([self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]))
            if len(word) <= REMEMBERED_CHARS:
                if len(self.words) >= WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def _put(self, words: list[str]) -> tuple[bytes, str]:
        found = list(map(self._word, words))
        return b"".join([x for x, _ in found]), " ".join([x for _, x in found])

    def _usual(self, text: str) -> tuple[bytes, str]:
        runs, (ids, shown) = text.lower().split(), self.runs
        parts = list(map(ids.get, runs))
        if None in parts:
            told = list(map(shown.get, runs))
            if len(ids) >= RUNS:
                ids.clear()
                shown.clear()
            for i, run in enumerate(runs):
                if parts[i] is None:
                    if run in ids:
                        parts[i], told[i] = ids[run], shown[run]
                        continue
                    parts[i], told[i] = self._put(self.find(run))
                    if len(run) <= REMEMBERED_CHARS:
                        ids[run], shown[run] = parts[i], told[i]
        else:
            told = list(map(shown.__getitem__, runs))
        return b"".join(parts), " ".join(told)

    def _told(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.names.__getitem__, ids))

    def _unusual(self, text: str) -> tuple[bytes, str]:
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return self._put([bytes(map(self.back.__getitem__, w)).decode() for w, _ in found])

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and what decoding makes of them: the entries with a space between."""
        if not any(map(text.__contains__, self.added)):
            return self._unusual(text) if self.unusual(text) else self._usual(text)
        out = []
        for i, part in enumerate(self.cut(text)):
            out.append(self._told([self.added[part]]) if i % 2 else self._unusual(part) if self.unusual(part) else self._usual(part))
        return b"".join([x for x, _ in out]), " ".join([x for x_ids, x in out if x_ids])


@functools.lru_cache(maxsize=2)
def word_end_tokenizer(path: str) -> WordEndTokenizer:
    return WordEndTokenizer(path)


def encode_texts(docs: DataFrame, tokenizer: str, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded for every row of docs, in the task that scans it.

    Ids and text are those of the tokenizers library for the file, without added special tokens; special strings inside
    texts become their single id, as is its default. Words are encoded once while a task remembers them, by the last
    token of each of their prefixes, in time linear in their length.

    Null and empty texts, and those of white space alone, have no ids and decode to the empty text. Repeated and null ids
    are rows of their own. Texts and words of any length are encoded whole. An empty table gives no rows. Extra columns
    are ignored. A file of another kind raises ValueError.
    """
    key, text = (F.col(f"`{c}`") for c in columns)
    names = ["doc_id", "n_tokens", "ids", "decoded"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_end_tokenizer(tokenizer)
        for batch in batches:
            lo, size, lot = 0, 0, []

            def handed(lo: int, lot: list[tuple[bytes, str]]) -> pa.RecordBatch:
                ids = [x for x, _ in lot]
                return pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(lot)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([x for _, x in lot], pa.string())], names=names)  # noqa: B023

            for i, t in enumerate(batch.column(1)):
                lot.append(own.encode(t.as_py() or ""))
                size += len(lot[-1][0])
                if size > LOT_BYTES:
                    yield handed(lo, lot)
                    lo, size, lot = i + 1, 0, []
            yield handed(lo, lot)

    return docs.select(key.cast("long").alias("doc_id"), text.alias("text")).mapInArrow(encoded, "doc_id long, n_tokens long, ids binary, decoded string")
