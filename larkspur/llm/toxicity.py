"""Toxicity scores from a learnt lexicon, matched with Levenshtein automata over its trie and weighed by context."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import giving_back, rows_of

#: Labelled documents of either class that the lexicon and the weights are fitted on, at most. All that is learnt, and so
#: what comes to the driver, is bounded by the words of these documents.
FIT_ROWS = 10_000
#: A term is kept if so many times likelier in toxic documents, in so many of them, and with this likelihood-ratio statistic.
LEAST_RATIO, LEAST_DOCS, LEAST_G = 6.0, 3, 20.0
#: Lengths of the word stems that may stand for all words that begin with them.
STEMS = (4, 5, 6, 7, 8)
#: Words on either side of a hit that tell quotation from abuse.
WINDOW = 6
#: Distinct words whose match a task remembers, and states of its automaton; what is forgotten is worked out again.
CACHE_WORDS, STATES = 500_000, 200_000
#: Rows that a task hands back at a time.
HANDED_ROWS = 1000

# fixed values: words that report speech or speak of words
REPORTING = frozenset("said says called calling quote quoted quotes word words term terms wrote writes insult insults slur slurs dit appelle mot sagte nannte wort dijo llama palabra".split())
# Quotation marks; one between two letters is an apostrophe.
_MARK = re.compile(r"[\"“”„«»]|(?<!\w)['’‘`]|['’‘`](?!\w)")
_OPENS, _CLOSES = re.compile(r"(?:^|(?<=[\s(\[{]))[\"“„«»'’‘`](?=\w)"), re.compile(r"(?<=[\w.,;:!?])[\"“”«»'’‘`](?=$|[\s.,;:!?)\]}])")
_WORD = re.compile(r"[^\W_]+(?:[^\w\s][^\W_]+)*")
_PART = re.compile(r"[^\W_]+")


def allowed_edits(length: int) -> int:
    """Edits by which a word of this length may be misspelled."""
    return 0 if length < 5 else 1 if length < 9 else 2


class LexiconAutomaton:
    """The union of the terms' Levenshtein automata, walked over the trie of the terms.

    A state is a set of (trie node, edits so far); sets are numbered and their transitions kept as they come up,
    so a word costs one look-up a character and most words end in the dead state after a few. A stem accepts
    every word that begins with it exactly; a term accepts words within allowed_edits() of it.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], states: int = STATES):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.edits: list[int] = [0]  # what the longest-suffering term below allows
        self.own: list[int] = [0]
        for words, of in ((terms, self.term), (stems, self.stem)):
            for word, weight in words.items():
                at, k = 0, allowed_edits(len(word)) if of is self.term else 0
                self.edits[0] = max(self.edits[0], k)
                for c in word:
                    nxt = self.children[at].get(c)
                    if nxt is None:
                        nxt = self.children[at][c] = len(self.children)
                        self.children.append({})
                        self.term.append(None)
                        self.stem.append(None)
                        self.edits.append(0)
                        self.own.append(0)
                    at = nxt
                    self.edits[at] = max(self.edits[at], k)
                of[at] = weight
                if of is self.term:
                    self.own[at] = k
        self.most_states = states
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.sets: list[bytes] = []
        self.moves: dict[int, int] = {}
        self.ends: list[tuple[float, int] | None] = []
        self.stopped: list[float | None] = []
        self.start = self._number(self._closed([(0, 0)]))

    def _closed(self, todo: list[tuple[int, int]]) -> dict[int, int]:
        """With the nodes that missing characters lead to; only the fewest edits of each node are kept."""
        best: dict[int, int] = {}
        while todo:
            node, e = todo.pop()
            if e > self.edits[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            if e < self.edits[node]:
                todo += [(child, e + 1) for child in self.children[node].values()]
        return best

    def _number(self, states: dict[int, int]) -> int:
        """The number of a set, which is kept as sorted integers: node times 4 and edits."""
        if not states:
            return -1
        key = array("i", sorted([node << 2 | e for node, e in states.items()])).tobytes()
        if (n := self.numbers.get(key)) is None:
            n = self.numbers[key] = len(self.sets)
            self.sets.append(key)
            accepted = [(self.term[node], e) for node, e in states.items() if self.term[node] is not None and e <= self.own[node]]
            self.ends.append(min(accepted, key=lambda x: (x[1], -x[0])) if accepted else None)
            self.stopped.append(max((self.stem[node] for node, e in states.items() if not e and self.stem[node] is not None), default=None))
        return n

    def _move(self, state: int, c: str) -> int:
        out: list[tuple[int, int]] = []
        for x in memoryview(self.sets[state]).cast("i"):
            node, e = x >> 2, x & 3
            if e < self.edits[node]:
                out.append((node, e + 1))
                out += [(child, e if c == d else e + 1) for d, child in self.children[node].items()]
            elif (child := self.children[node].get(c)) is not None:
                out.append((child, e))
        return self._number(self._closed(out))

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the nearest term or the heaviest stem that accepts the word."""
        if len(self.sets) > self.most_states or len(self.moves) > 4 * self.most_states:
            self._forget()
        state, stem = self.start, None
        for c in word:
            at = state << 21 | ord(c)
            state = self.moves.get(at, -2)
            if state == -2:
                state = self.moves[at] = self._move(at >> 21, c)
            if state < 0:
                break
            if (s := self.stopped[state]) is not None and (stem is None or s > stem):
                stem = s
        end = self.ends[state] if state >= 0 else None
        if stem is not None and (end is None or end[1]):
            return stem, 0
        return end


@dataclass
class Model:
    terms: dict[str, float]
    stems: dict[str, float]
    innocent: frozenset[str]
    weights: tuple[float, ...]

    def matcher(self):
        """word -> (weight, edits) or None, remembered; words known from clean documents are no misspellings."""
        automaton, known = LexiconAutomaton(self.terms, self.stems), {}

        def match(word: str) -> tuple[float, int] | None:
            try:
                return known[word]
            except KeyError:
                pass
            found = automaton.match(word)
            if found is not None and found[1] and word in self.innocent:
                found = None
            if found is None and not word.isalnum():
                parts = [m for p in _PART.findall(word) if (m := automaton.match(p)) is not None and not (m[1] and p in self.innocent)]
                found = max(parts, default=None, key=lambda m: (-m[1], m[0]))
            if len(known) >= CACHE_WORDS:
                known.clear()
            known[word] = found
            return found

        return match


def features(text: str, match) -> tuple[float, float, float, float]:
    """Sums over a text's distinct hits: exact abuse, misspelled abuse and quoted terms, and the share of words hit."""
    lower = text.lower()
    words = _WORD.findall(lower)
    hit = {w for w in set(words) if match(w) is not None}
    if not hit:
        return 0.0, 0.0, 0.0, 0.0
    spans = [m.span() for m in _WORD.finditer(lower)]
    best: dict[str, tuple[float, int, float]] = {}
    n = 0
    for i, w in enumerate(words):
        if w in hit:
            n += 1
            weight, edits = match(w)
            quoted = _quoted(lower, words, spans, i)
            if w not in best or quoted < best[w][2]:
                best[w] = (weight, edits, quoted)
    exact = sum(w * (1 - q) for w, e, q in best.values() if not e)
    fuzzy = sum(w * (1 - q) for w, e, q in best.values() if e)
    quote = sum(w * q for w, e, q in best.values())
    return math.log1p(exact), math.log1p(fuzzy), math.log1p(quote), math.log1p(1000 * n / len(words))


def _quoted(text: str, words: list[str], spans: list[tuple[int, int]], i: int) -> float:
    """0 for plain use up to 1 for quotation, from the words and marks within WINDOW words of the hit."""
    lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    left, right = text[max(0, spans[lo][0] - 1) : spans[i][1]], text[spans[i][0] : spans[hi - 1][1] + 2]
    at, length = spans[i][0] - max(0, spans[lo][0] - 1), spans[i][1] - spans[i][0]
    before = max((m.start() for m in _MARK.finditer(left) if m.end() <= at), default=None)
    after = next((m.start() for m in _MARK.finditer(right) if m.start() >= length), None)
    # the nearest mark on the left opens and the nearest on the right closes: they enclose the hit
    opened = before is not None and after is not None and _OPENS.match(left, before) is not None and _CLOSES.match(right, after) is not None
    reported = any(w in REPORTING for w in words[lo:hi])
    return 0.9 if opened and reported else 0.6 if opened else 0.5 if reported else 0.0


@giving_back
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class with each word and stem."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in rows_of(batch, "text", "toxic"):
            words = set(_PART.findall((text or "").lower()))
            seen[toxic].update(f"={w}" for w in words if len(w) > 2)
            seen[toxic].update({f"^{w[:n]}" for w in words for n in STEMS if len(w) > n})
    names = list(seen[0] | seen[1])
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([s[x] for x in part], pa.int64()) for s in seen)], names=["name", "clean", "toxic"])


def _g_statistic(n_clean: int, n_toxic: int) -> F.Column:
    """Likelihood-ratio statistic of word and class, from the documents of either class that hold the word."""
    n, have = n_clean + n_toxic, F.col("clean") + F.col("toxic")

    def part(seen: F.Column, margin: F.Column, of: int) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen * n / (margin * of))).otherwise(0.0)

    return 2 * (part(F.col("toxic"), have, n_toxic) + part(F.col("clean"), have, n_clean) + part(n_toxic - F.col("toxic"), n - have, n_toxic) + part(n_clean - F.col("clean"), n - have, n_clean))


def _lexicon(rows: Iterable, n_clean: int, n_toxic: int) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and stems weighed by log odds, from rows with the best first.

    A stem that one term makes up leaves its place to the term, for which misspellings count too. Of stems that
    begin with each other only the best stays, and it stands for the terms below it.
    """
    terms: dict[str, float] = {}
    stems: dict[str, float] = {}
    rows = list(rows)
    alone = {r.name[1:]: r.toxic for r in rows if r.name[0] == "="}
    for r in rows:
        word = r.name[1:]
        weight = math.log((r.toxic + 0.5) / (n_toxic + 1)) - math.log((r.clean + 0.5) / (n_clean + 1))
        if any(word.startswith(s) for s in stems):
            continue
        if r.name[0] == "=":
            terms[word] = weight
        elif not any(s.startswith(word) for s in stems) and not any(t.startswith(word) and n > 0.6 * r.toxic for t, n in alone.items()):
            stems[word] = weight
    return {t: w for t, w in terms.items() if not any(t.startswith(s) for s in stems)}, stems


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 30) -> tuple[float, ...]:
    """Weights of a penalised logistic regression, intercept first, for the prior share of toxic documents."""
    a = np.column_stack([np.ones(len(x)), x])
    share = float(y.mean())
    w = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    beta, penalty = np.zeros(a.shape[1]), np.array([1e-3, *[0.1] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - penalty * beta)
        beta = beta + step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
    return tuple(float(b) for b in beta)


def held_out(column: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, columns: tuple[str, str] = ("doc_id", "text")) -> Model:
    """Learns lexicon and weights from labels (doc_id, toxic) of documents that aren't held out.

    Of either class the fit_rows labelled documents with the smallest hash of the id are used; only they are read
    past the join, and only bounded tables come to the driver: the lexicon and the features of these documents.
    Equal texts count once, as toxic if one of them is. Without texts of both classes all get one score, as clean.
    """
    spark, (key, text) = docs.sparkSession, columns
    rated = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r["count"] for r in rated.groupBy("toxic").count().collect()}
    chosen = [r for y in (0, 1) for r in rated.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).collect()]
    nothing = Model({}, {}, frozenset(), (-2.0, 0.0, 0.0, 0.0, 0.0))
    if not n.get(0) or not n.get(1):
        return nothing
    few = F.broadcast(spark.createDataFrame(chosen, rated.schema))  # 2 * fit_rows rows at most
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(few, "doc_id")
    sample = own.groupBy("text").agg(F.max("toxic").alias("toxic")).persist()
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    if not n_clean or not n_toxic:
        sample.unpersist()
        return nothing
    counts = sample.mapInArrow(_counts, "name string, clean long, toxic long").groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    likelier = (F.col("toxic") + 0.5) / (n_toxic + 1) >= LEAST_RATIO * (F.col("clean") + 0.5) / (n_clean + 1)
    kept = counts.filter((F.col("toxic") >= LEAST_DOCS) & likelier).withColumn("g", _g_statistic(n_clean, n_toxic)).filter(F.col("g") >= LEAST_G)
    terms, stems = _lexicon(kept.orderBy(F.desc("g"), "name").collect(), n_clean, n_toxic)
    draft = Model(terms, stems, frozenset(), ())

    @giving_back
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of either class with each word that would pass as a misspelling, or is a part of one that would."""
        match, found = draft.matcher(), (Counter(), Counter())
        for batch in batches:
            for text, toxic in rows_of(batch, "text", "toxic"):
                found[toxic].update({p for w in set(_WORD.findall((text or "").lower())) if (m := match(w)) and m[1] for p in [w, *_PART.findall(w)]})
        words = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([f[w] for w in words], pa.int64()) for f in found)], names=["word", "clean", "toxic"])

    passing = sample.mapInArrow(near, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # a word is innocent if it is likelier in clean documents: one mislabelled document doesn't clear a misspelling
    innocent = frozenset(r.word for r in passing.filter((F.col("clean") > 0) & ((F.col("clean") + 0.5) / (n_clean + 1) >= (F.col("toxic") + 0.5) / (n_toxic + 1))).collect())
    model = Model(terms, stems, innocent, ())

    @giving_back
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for batch in batches:
            rows = [(*features(t or "", match), y) for t, y in rows_of(batch, "text", "toxic")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * 5, names=["a", "b", "c", "d", "y"])

    got = np.array([tuple(r) for r in sample.mapInArrow(measure, "a double, b double, c double, d double, y double").collect()])
    sample.unpersist()
    model.weights = _logistic(got[:, :4], got[:, 4], n[1] / (n[0] + n[1]))
    return model


def score_toxicity(docs: DataFrame, model: Model, columns: tuple[str, str] = ("doc_id", "text"), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, and the columns of docs to carry; in one pass without a shuffle.

    Texts are read whole. Null and empty texts get the score of a text without hits. Null ids are scored and not
    held out; repeated rows get equal scores. An empty table gives no rows. Extra columns are ignored.
    """
    key, text = columns

    @giving_back
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        b0, *b = model.weights
        for batch in batches:
            out = []
            for t in batch.column(at):
                x = features(t.as_py() or "", match)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b0 + sum(i * j for i, j in zip(b, x, strict=True)))))))
            got, also = pa.array(out, pa.float64()), range(first, first + len(carried))
            columns = [batch.column(0), batch.column(1), got, pa.array([int(s >= 0.5) for s in out], pa.int32()), *(batch.column(i) for i in also)]
            scored = pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", *carried])
            yield from (scored.slice(i, HANDED_ROWS) for i in range(0, scored.num_rows, HANDED_ROWS))

    carried = [c for c in carry if c != "doc_id"]
    at = 2 + carried.index(text) if text in carried else 2  # a text that is carried goes to the workers once
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), *[F.col(text).alias("text_scored")][: text not in carried], *carried)
    first = 2 + (text not in carried)
    kinds = "".join(f", `{c}` {dict(rows.dtypes)[c]}" for c in carried)
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int" + kinds)
