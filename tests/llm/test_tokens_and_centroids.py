"""Token alignment, prefix BPE and centroid clustering against brute-force versions and the tokenizers' own libraries."""

import collections
import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import align, centroids, prefixbpe
from larkspur.llm.common import library_tokenizer, tokenizer_path

BYTE, PIECE, WORD = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
LONG = "Long words, naïve ones and 12345 numbers — again and again. " * 3000
EDGE = [
    (1, "Hello world, it's a test."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "Hello world, it's a test."), (7, "x<|endoftext|>Y <|startoftext|><s></s>"), (8, "日本語 🙂 é"),
    (8, "repeated id"), (8, "repeated id"), (None, "no id"), (9, "a" * 5000), (10, "under▁score"), (11, "ΣΑΣ İI ǅ \x1c\x1d a\x85b\xa0c ½ ² 12 ٣ é"), (12, "'S 'T DON'T we'LL '' !!!? ...."), (13, "\x00 nul"), (14, "<0x41> <unk>"),
]


def documents(spark, rows):
    names = ("source", "ids", "block", "radix", "totals", "groups", "slice", "lot", "decoded", "slices")
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("x") for n in names})


def brute_alignment(rows):
    """The contract, token by token."""
    from sentencepiece import SentencePieceProcessor

    slow, model = library_tokenizer(BYTE, False), SentencePieceProcessor(model_file=PIECE)
    back = align._unicode_to_byte()
    told, links = [], collections.Counter()
    for doc, text in rows:
        a, b, la, lb = [], [], [], []
        if text:
            a, b = slow.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            la = [bytes(back[c] for c in slow.id_to_token(i)) for i in a]
            lb = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(la) == b"".join(lb) == (" " + text).encode():
                a, b, la, lb = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in la]).tolist(), np.cumsum([len(x) for x in lb]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, lo, own = [], 0, []
        for c in cuts:
            groups.append(",".join(str(i) for i, e in zip(a, ends_a) if lo < e <= c) + "|" + ",".join(str(i) for i, e in zip(b, ends_b) if lo < e <= c)) if len(a) < 1000 else None
            lo = c
        at_a, at_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
        own = [(at_a[c], at_b[c]) for c in cuts]
        links.update(own)
        told.append((doc, len(a), len(b), len(cuts), own, ";".join(groups) if groups and groups[0] is not None else None))
    highest = {}
    for (a, b), n in links.items():
        highest[b] = max(highest.get(b, 0), n)
    return [(doc, na, nb, g, len(own), sum(links[p] == highest[p[1]] for p in own), sum(links[p] for p in own), "" if not na else text and hashlib.sha256(text.encode()).hexdigest()) for doc, na, nb, g, own, text in told]


@pytest.mark.parametrize("slice_bytes,frame", [(align.SLICE_BYTES, align.FRAME), (2000, 7)])
def test_alignment_equals_brute_force(spark, monkeypatch, slice_bytes, frame):
    monkeypatch.setattr(align, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(align, "FRAME", frame)
    monkeypatch.setattr(align, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(align, "OPEN_BLOCKS", 2)
    rng = random.Random(3)
    rows = EDGE + [(100 + i, " ".join(rng.choice(["the", "naïve", "Straße", "unbelievable", "tokens", "x", "漢字", "re-run"]) for _ in range(rng.randint(1, 80)))) for i in range(150)]
    got = sorted((tuple(r) for r in align.align_tokens(documents(spark, rows).repartition(5), BYTE, PIECE).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)
    want = sorted(brute_alignment(rows), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])


def test_alignment_texts_and_empty_table(spark):
    r = align.align_tokens(documents(spark, [(1, "Hello")]), BYTE, PIECE, keep_groups=True).first()
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 and "|" in r.groups
    assert align.align_tokens(documents(spark, [(1, "x")]).limit(0), BYTE, PIECE).count() == 0
    assert [tuple(r)[:7] for r in align.align_tokens(documents(spark, [(1, None), (2, "")]), BYTE, PIECE).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0)]


def test_runs_merge_in_order():
    rng = np.random.default_rng(1)
    want, runs = collections.Counter(), []
    for _ in range(9):
        key, total = np.unique(rng.integers(0, 1 << 40, 5000) >> rng.integers(0, 36), return_counts=True)
        runs.append(align._frames(key, total))
        want.update(dict(zip(key.tolist(), total.tolist())))
    key, total = align.merged_runs(runs)
    assert dict(zip(key.tolist(), total.tolist())) == want and (np.diff(key) > 0).all()


def same_ids(own, slow, text):
    ids = slow.encode(text, add_special_tokens=False).ids
    got, shown = own.encode(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids
    assert shown == slow.decode(ids, skip_special_tokens=False)


def test_prefix_bpe_equals_the_library(monkeypatch):
    own, slow, rng = prefixbpe.WordEndTokenizer(WORD), library_tokenizer(WORD), random.Random(1)
    for n, name in ((50, "WORDS"), (40, "RUNS"), (300, "PAIRS")):
        monkeypatch.setattr(prefixbpe, name, n)
    for _, text in EDGE:
        same_ids(own, slow, text or "")
    for _ in range(1500):
        same_ids(own, slow, "".join(rng.choice("abcdeeinthrs") for _ in range(rng.randint(1, 60))))
        same_ids(own, slow, "".join(rng.choice(["a", "B", "é", "ß", "'", "s", " ", "!", "1", "я", "Ω", "漢", "́", "\t", "ﬁ", "🙂", "e", "<|endoftext|>"]) for _ in range(rng.randint(1, 60))))
        same_ids(own, slow, rng.choice("aelotz") * rng.randint(1, 200))


def test_every_entry_of_the_vocabulary_is_its_own_encoding():
    bpe = prefixbpe.word_end_tokenizer(WORD).bpe

    def symbols(t):
        return [x for p in bpe.parts[t] for x in symbols(p)] if t in bpe.parts else [t]

    assert all(bpe.encode(symbols(t)) == [t] for t in bpe.parts)


def test_prefix_bpe_by_plain_merging():
    """A made vocabulary with many overlaps, against merging the first lowest pair again and again."""
    rng = random.Random(5)
    merges, tokens = [], {0: "a", 1: "b", 2: "c"}
    while len(merges) < 60:
        text = "".join(rng.choice("aabc") for _ in range(300))
        a, b = rng.choice(list(tokens)), rng.choice(list(tokens))
        if tokens[a] + tokens[b] not in tokens.values() and len(tokens[a] + tokens[b]) < 9 and merged(merges, list(tokens[a] + tokens[b])) == [a, b]:
            tokens[3 + len(merges)] = tokens[a] + tokens[b]
            merges.append((a, b, 3 + len(merges)))
    bpe = prefixbpe.PrefixBpe(merges, [0, 1, 2])
    for _ in range(800):
        text = [rng.choice("aaabc") for _ in range(rng.randint(1, 40))]
        assert bpe.encode(["abc".index(c) for c in text]) == merged(merges, text)
    for bad in ([(0, 1, 3), (1, 0, 3)], [(0, 4, 3), (0, 1, 4)]):
        with pytest.raises(ValueError):
            prefixbpe.PrefixBpe(bad, [0, 1, 2])


def merged(merges, text):
    rank = {(a, b): c for a, b, c in merges}
    ids = ["abc".index(c) for c in text]
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank), default=None)
        if found is None:
            return ids
        ids[found[1] : found[1] + 2] = [found[0]]


def test_encoded_rows(spark):
    slow = library_tokenizer(WORD)
    got = prefixbpe.encode_texts(documents(spark, EDGE).repartition(3), WORD).collect()
    want = [(doc, slow.encode(text or "", add_special_tokens=False).ids) for doc, text in EDGE]
    assert sorted((r.doc_id or -1, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == sorted((doc or -1, len(ids), struct.pack(f"<{len(ids)}I", *ids), slow.decode(ids, skip_special_tokens=False)) for doc, ids in want)
    assert prefixbpe.encode_texts(documents(spark, EDGE).limit(0), WORD).count() == 0
    with pytest.raises(ValueError):
        prefixbpe.WordEndTokenizer(BYTE)


def brute_clusters(rows, k=40, rounds=5, size=64):
    kept = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v is not None and len(v) == size and None not in v and np.isfinite(v).all()]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist()))[:k]
    c = [x.copy() for _, x in first]
    for step in range(rounds + 1):
        own = [min((int(((x - y) ** 2).sum()), j) for j, y in enumerate(c)) for _, x in kept]
        for j in range(len(c)) if step < rounds else ():
            held = [x for (_, x), (_, o) in zip(kept, own) if o == j]
            if held:
                c[j] = np.array([int(s) // len(held) for s in np.sum(held, axis=0)])
    each = collections.Counter()
    for d, j in own:
        each[j] += d
    return sorted(((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own)), key=repr)


def vector_rows(kind):
    rng = np.random.default_rng(4)
    if kind == "few":
        x = rng.normal(size=(7, 64))
    elif kind == "clustered":
        x = rng.normal(size=(60, 64))[rng.integers(0, 60, 700)] * 3 + rng.normal(size=(700, 64)) * 0.02
    elif kind == "large":
        x = rng.normal(size=(120, 64)) * 20_000
    else:
        x = rng.normal(size=(300, 64))
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    if kind == "odd":
        rows += [(1000 + i, rows[0][1]) for i in range(250)] + [rows[3], rows[3], (None, rows[5][1]), (2000, None), (2001, [1.0] * 63), (2002, [None] * 64), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64), (2005, []), (2006, [0.0] * 64)]
    return rows


@pytest.mark.parametrize("kind", ["few", "clustered", "large", "odd"])
def test_clusters_equal_brute_force(spark, kind):
    rows = vector_rows(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit(1) for n in ("id", "v", "lot", "cluster", "key", "f", "label")}).repartition(3)
    out = centroids.cluster_vectors(df)
    assert sorted((tuple(r)[:6] for r in out.collect()), key=repr) == brute_clusters(rows)
    if kind == "clustered":
        assert out.agg(F.avg("compared")).first()[0] < 8  # of 40: the boxes tell most centroids apart
    assert centroids.cluster_vectors(df.limit(0)).count() == 0


def test_blocks_follow_groups_of_vectors():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(size=(50, 64))[rng.integers(0, 50, 4000)] + rng.normal(size=(4000, 64)) * 0.01)).astype(np.int32)
    key = centroids.Layout.of(x.astype(float), len(x)).keys(x.astype(float), np.arange(len(x)))
    x, key = x[np.argsort(key)], np.sort(key)
    ends = centroids.zone_cuts(x, key)
    assert ends[-1] == len(x) and max(np.diff([0, *ends])) <= centroids.BLOCK
    wide = [hi - lo for lo, hi in zip([0, *ends[:-1]], ends) if (x[lo:hi].max(axis=0) - x[lo:hi].min(axis=0)).max() > 100]
    assert sum(wide) < 0.1 * len(x)
    noise = np.floor(256 * rng.normal(size=(4000, 64))).astype(np.int32)
    key = np.sort(centroids.Layout.of(noise.astype(float), len(noise)).keys(noise.astype(float), np.arange(len(noise))))
    assert len(centroids.zone_cuts(noise, key)) < 40  # nothing to tell apart: few blocks


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(2)
    for _ in range(300):
        c = rng.integers(-20, 20, (rng.integers(1, 12), 4))
        x = rng.integers(-25, 25, 4) + rng.integers(0, rng.integers(1, 15), (6, 4))
        may = centroids.candidates(x.min(axis=0), x.max(axis=0), c)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        for row in d:
            assert set(np.flatnonzero(row == row.min())) <= set(may)


def test_the_curve_visits_every_cell_once_and_by_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        place = centroids.hilbert_places(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_equal_vectors_spread_over_ranges():
    x = np.zeros((40_000, 8)) + np.array([1.0] * 8)
    x[::3] = np.random.default_rng(1).normal(size=(len(x[::3]), 8))
    layout = centroids.Layout.of(x[: centroids.FIT_ROWS], len(x))
    held = np.bincount(np.searchsorted(layout.ranges, layout.keys(x, np.arange(len(x))), side="right"))
    assert len(layout.ranges) >= 8 and held.max() < 1.5 * held.mean()
