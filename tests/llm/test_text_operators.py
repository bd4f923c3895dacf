"""Edge rows and brute-force versions of the operators on documents, pages and conversations."""

import collections
import hashlib
import re
import struct
import time
import zlib
import gzip

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import chat, html, imatch, mixing, ngramjoin, packing, tokencount, toxicity, warc
from larkspur.llm.common import byte_level_encoder, library_tokenizer, tokenizer_path

BPE = tokenizer_path("byte_bpe_50k.json")
LONG = "Long words, naïve ones and 12345 numbers — again and again. " * 3000
EDGE = [(1, "Hello world, it's a test."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "Hello world, it's a test."), (7, "x<|endoftext|>y"), (8, "日本語 🙂 é"), (8, "repeated id"), (8, "repeated id"), (None, "no id"), (9, "a" * 5000)]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"source": F.lit("s"), "ids": F.lit(1), "n": F.lit(2), "range": F.lit(0), "key": F.lit("k")}) if extra else df


def test_fast_encoder_equals_the_library():
    fast, slow = byte_level_encoder(BPE), library_tokenizer(BPE)
    for _, text in [*EDGE, (0, "<|endoftext|>" * 3), (0, "a  b   c\n\n d e"), (0, "'s 'T don't"), (0, " " * 3000)]:
        assert fast(text or "").tolist() == slow.encode(text or "", add_special_tokens=False).ids


def test_packing_covers_every_id_once(spark):
    rows = EDGE + [(100 + i, "word " * (i * 37 % 700)) for i in range(200)]
    got = packing.pack_documents(documents(spark, rows).repartition(3), BPE).collect()
    slow = library_tokenizer(BPE)
    ids = collections.defaultdict(list)
    for doc, text in rows:
        ids[doc].append(slow.encode(text or "", add_special_tokens=False).ids + [1])
    pieces, windows = collections.Counter(), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
        assert any(len(x) == r.doc_tokens and zlib.crc32(struct.pack(f"<{r.length}I", *x[r.start : r.start + r.length])) == r.ids_crc32 for x in ids[r.doc_id])
    assert pieces == {doc: sum(map(len, x)) for doc, x in ids.items()}
    padded = 0
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded == 0
    again = packing.pack_documents(documents(spark, rows[:0]), BPE)
    assert again.count() == 0


def test_sum_of_squares_places_as_brute_force_does():
    rng, window, closed = np.random.default_rng(3), 64, []
    packer = packing.SumOfSquares(window, closed.append)
    counts = [0] * (window + 1)
    for i in range(500):
        size = int(rng.integers(1, window))

        def after(h, size=size):
            c = list(counts)
            c[h] -= h > 0
            c[h + size] += h + size < window
            return sum(x * x for x in c[1:window])

        fits = [h for h in range(window - size + 1) if h == 0 or counts[h]]
        best = min(fits, key=lambda h: (after(h), -h))
        counts[best] -= best > 0
        counts[best + size] += best + size < window
        packer.place((i, 0, np.zeros(size), size), size)
        assert packer.level.tolist() == counts and sum(counts) == packer.open
    for h in range(1, window):
        assert len(packer.bins[h]) == counts[h]


def test_settling_keeps_every_id_and_the_fullest_windows():
    rng, window, closed = np.random.default_rng(5), 64, []
    packer = packing.SumOfSquares(window, closed.append)
    pieces = [(i, 0, np.arange(n), n) for i, n in enumerate(rng.integers(1, window, 300).tolist())]
    for p in pieces:
        packer.place(p, p[3])
        packer.settle(20)
        assert packer.open <= 20
    before = [held for h in range(window - 1, 0, -1) for held in packer.bins[h]]
    packer.settle(0)
    assert packer.open == 0 and not packer.level.any()
    assert all(any(set(map(repr, before[0])) <= set(map(repr, w)) for w in closed) for _ in "x")
    got = collections.defaultdict(list)
    for held in closed:
        total = sum(len(ids) for _, _, ids, _ in held)
        assert total == window or total & (total - 1) == 0
        for doc, start, ids, _ in held:
            assert ids.tolist() == list(range(start, start + len(ids)))
            got[doc] += ids.tolist()
    assert {d: sorted(x) for d, x in got.items()} == {p[0]: list(range(p[3])) for p in pieces}


def test_token_counts_equal_the_library(spark):
    rows = EDGE + [(200 + i, f"token number {i} of {i % 7} the the the") for i in range(300)]
    got = tokencount.count_tokens(documents(spark, rows).repartition(4), BPE, limit=10).collect()
    slow = library_tokenizer(BPE)
    want = sorted((str(d), len((t or "").encode()), n := len(slow.encode(t or "", add_special_tokens=False).ids), n > 10) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert tokencount.count_tokens(documents(spark, rows[:0]), BPE).count() == 0


MARKS = ["</s>[INST] ok [/INST]", "<s>", "[/ROLE]", "<\\s>", "<\\\\/s>", " [/INST] ", "[ROLE:", "plain", "", "<", "[", "\\"]


def test_conversations_come_back(spark):
    rows = [(1, i, r, m) for i, (r, m) in enumerate((r, m) for m in MARKS for r in ("user", "assistant", "system", "tool", None))]
    rows += [(2, 0, "user", "only asked"), (3, 0, "assistant", None), (3, 0, "assistant", None), (None, 1, "user", "x"), (4, None, "user", "a"), (4, 1, "assistant", "b" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in chat.digest_examples(chat.expand_replies(df)).collect()}
    groups = collections.defaultdict(list)
    for c, t, r, m in rows:
        groups[c].append((-1 if t is None else t, r or "", m or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort(key=lambda x: x[0])
        loss = "".join(m for _, r, m in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{m}\n" for _, r, m in turns).encode()).hexdigest()
    examples = chat.expand_replies(df.filter("conv_id = 1")).collect()
    template = chat.Template()
    assert sum(e.target_turn is not None for e in examples) == len(MARKS)
    for e in examples:
        assert e.target_turn is None or list(template.turns(e.text))[-1] == ("assistant", template.unescape(e.text[e.loss_start : e.loss_end]))
    assert chat.digest_examples(chat.expand_replies(df.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li>Menu</ul></nav><div class="ad-box ads">Buy</div><div class="cookie-notice">OK?</div>
<main><article><header><h1>Head &amp; line</h1></header><p><b>One<br>two&nbsp;&#33;<p>Thr<i>ee</i> <!-- c -->x<div class="share">share me</div>
<ul><li>a<li>b</ul><form><label>mail</label><input></form></article><section id="comments"><article class="comment"><p>First!</article></section></main>
<aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_article_alone_stays(spark):
    pages = [(1, "http://a.com/1", PAGE), (2, None, None), (3, "x", ""), (4, "http://a.com/4", "no tags &lt;here&gt;"), (5, "http://a.com/5", "<p>cut off <b"), (6, "http://a.com/6", "<div>" * 3000 + "deep"), (1, "http://a.com/1", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "cut": F.lit(1), "text": F.lit("t")})
    got = [tuple(r) for r in html.extract_main_text(df).orderBy("page_id").collect()]
    text = "Head & line\nOne two !\nThree x\na\nb"
    assert got[0] == got[1] == (1, "http://a.com/1", text, len(text))
    assert [g[2] for g in got[2:]] == ["", "", "no tags <here>", "cut off", "deep"]
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_style_tree_takes_what_a_site_repeats(spark):
    page = "<html><body><div class='x{0}'><p>Welcome to our site</p></div><div class='y'><p>Text number {0}</p><p>and {1}</p></div></body></html>"
    same = [(i, "http://b.com/", "<html><body><div class='y'><p>Same text</p></div></body></html>") for i in range(100, 120)]
    df = spark.createDataFrame([(i, f"http://a.com/{i}", page.format("", i * i).replace("number ", f"number {i}")) for i in range(12)] + same, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract_main_text(df).collect()}
    assert got[3] == "Text number 3\nand 9" and got[100] == "Same text"  # copies of one page are no boilerplate


def test_slugs_of_headings_and_sections_are_no_noise():
    body = "<h2 id='related-work'>Related work</h2><section id='search-methods' class='foot-notes'><p id='side-effects'>Side effects</p></section><p class='notice'>Note</p><div id='search'>Found</div>"
    text = "Related work\nSide effects\nNote\nFound"
    for tag in ("article", "main"):
        assert html.main_text(f"<body><{tag}>{body}<div class='box share'>share</div><ul class='related'><li>x</ul><div id='comments'>c</div></{tag}></body>") == text
    bare = html.main_text("<body><div><h2 id='related-work'>Related work</h2><section id='search-methods'><p id='side-effects'>Side effects</p></section></div><div id='site-search'>s</div><section id='comments'>c</section></body>")
    assert bare == "Related work\nSide effects"


def test_importance_decides_inside_articles(spark):
    page = "<html><body><{0}><h1>{1}</h1><p>Text number {2} and {3}</p><h2>Method</h2><p>More of {3}</p><div class='box'><p>Written by our editors</p></div></{0}></body></html>"
    rows = [(i, f"http://{tag}.com/{i}", page.format(tag, f"Title {i}", i, i * i)) for tag in ("article", "main") for i in range(12)]
    # one article on 12 pages that differ outside it
    rows += [(100 + i, f"http://copies.com/{i}", f"<body><div>Page {i} of the list</div><article><div class='lead'>Copied lead</div><p>Copied text</p></article></body>") for i in range(12)]
    # the text beside the articles, which are teasers
    rows += [(200 + i, f"http://teasers.com/{i}", f"<body><main><div class='text'>A long text of its own, number {i}, about {i * i}</div><article class='teaser'>Read more</article></main></body>") for i in range(12)]
    got = {r.url: r.text for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for tag in ("article", "main"):
        assert got[f"http://{tag}.com/3"] == "Title 3\nText number 3 and 9\nMethod\nMore of 9"
    assert got["http://copies.com/3"] == "Copied lead\nCopied text"
    assert got["http://teasers.com/3"] == "A long text of its own, number 3, about 9"


def test_two_classes_of_importance():
    assert html.boilerplate_below([]) is None and html.boilerplate_below([0.97, 0.98, 0.99]) is None
    for low, high in (([0.49, 0.56], [0.87, 0.88, 0.97]), ([0.87, 0.87, 0.89], [0.94, 0.99])):
        assert max(low) < html.boilerplate_below(low + high) < min(high)


def test_deep_and_stray_tags_take_linear_time():
    for page in ("<div>" * 50_000 + "deep", "<span>" * 50_000 + "</b></i>" * 50_000 + "deep", "<p><b>" * 50_000 + "deep"):
        began = time.process_time()
        assert html.parse(page)[1][-1][1] == "deep" and time.process_time() - began < 5


def toxic_corpus(n=400):
    rng = np.random.default_rng(5)
    plain = [f"w{i:03d}ord" for i in range(300)]
    bad = ["scoundrel", "blockhead", "nincompoop"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        toxic = i % 5 == 0
        if toxic:
            for w in rng.choice(bad, 2):
                words.insert(int(rng.integers(40)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_catches_misspellings(spark):
    rows, labels = toxic_corpus()
    docs, rated = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, rated)
    assert {"scoundrel", "blockhead", "nincompoop"} <= set(model.terms)
    by = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    truth = dict(labels)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    held = [i for i in truth if by[i].held_out]
    assert sum(by[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    plain = "w001ord w002ord w003ord w004ord w005ord w006ord w007ord w008ord "
    probe = documents(spark, [(1, plain + "you scoundrl and blokhead " + plain), (2, plain + plain), (3, None), (4, ""), (None, plain), (5, plain * 20_000 + "scoundrel nincompoop")])
    p = {r.doc_id: r for r in toxicity.score_toxicity(probe, model).collect()}
    assert p[1].predicted == 1 and p[2].predicted == p[3].predicted == p[4].predicted == 0 and p[2].score == p[3].score and 0 <= p[5].score <= 1
    assert toxicity.score_toxicity(probe.limit(0), model).count() == 0
    assert toxicity.fit(docs.limit(0), rated.limit(0)).terms == {}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng, terms = np.random.default_rng(1), ["abcde", "abcdx", "bad", "abcdeabcde", "eeeee"]
    automaton = toxicity.LexiconAutomaton(dict.fromkeys(terms, 1.0), {"ecb": 2.0})
    for _ in range(4000):
        word = "".join(rng.choice(list("abcdex"), int(rng.integers(1, 12))))
        near = min((edits(word, t) for t in terms if edits(word, t) <= toxicity.allowed_edits(len(t))), default=None)
        want = (2.0, 0) if word.startswith("ecb") and near != 0 else None if near is None else (1.0, near)
        assert automaton.match(word) == want, word


def test_quotation_weighs_less():
    model = toxicity.Model({"scoundrel": 4.0}, {}, frozenset(), ())
    match = model.matcher()
    abuse, quoted = toxicity.features("you are a scoundrel and always were", match), toxicity.features('he said the word "scoundrel" once in print', match)
    assert abuse[0] > quoted[0] and abuse[2] == 0 < quoted[2]


def test_fingerprints_of_edits(spark):
    words = [f"term{i}" for i in range(400)]
    rng = np.random.default_rng(2)
    rows = [(i * 3, " ".join(rng.choice(words, int(rng.integers(3, 80))))) for i in range(120)]
    rows += [(400, rows[0][1]), (401, None), (402, ""), (402, ""), (403, "word " * 20_000), (404, "é🙂" * 7), (None, "no id"), (-5, "first")]
    got = imatch.fingerprint_edits(documents(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    order = sorted((d, t or "") for d, t in rows if d is not None)
    want = collections.Counter()
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        h = len(t) // 2
        want[d, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()] += 1
    want[None, 5, hashlib.sha256(b"no ").hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = collections.defaultdict(set)
    for r in got:
        prints[dict((a, b or "") for a, b in rows)[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values()) and len(prints) == len({p for s in prints.values() for p in s})
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got])
    assert imatch.fingerprint_edits(documents(spark, rows[:0])).count() == 0


def test_fingerprints_without_python(spark):
    plan = imatch.fingerprint_edits(documents(spark, EDGE))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_ranges_chain_into_each_other(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    rows = [(i * i % 1009, f"text {i}") for i in range(100)]
    got = imatch.in_order(documents(spark, rows, extra=False)).collect()
    order = sorted((d, t) for d, t in rows)
    assert {(r.doc_id, r.text, r.next_text) for r in got} == {(d, t, n) for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    place = {(r["range"], r.nth): r.text for r in got}
    assert all(place[r.next_range, r.next_nth] == r.next_text for r in got) and len({r["range"] for r in got}) > 5


@pytest.mark.parametrize("case", ["one far id", "a shared id", "shared null ids"])
def test_ranges_stay_small(spark, monkeypatch, case):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 10)
    rows = {"one far id": [(i, f"text {i}") for i in range(300)] + [(10**15, "far")], "a shared id": [(i if i % 3 else 50, f"text {i}") for i in range(300)], "shared null ids": [(i if i % 3 else None, f"text {i}") for i in range(300)]}[case]
    got = imatch.in_order(documents(spark, rows, extra=False).repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    assert max(collections.Counter(r["range"] for r in got).values()) <= 40
    place = {(r["range"], r.nth): r for r in got}
    ring, at = [], next(r for r in got if r.doc_id == min(d for d, _ in rows if d is not None))
    for _ in range(sum(d is not None for d, _ in rows)):
        ring.append(at)
        assert place[at.next_range, at.next_nth].text == at.next_text
        at = place[at.next_range, at.next_nth]
    assert len({r.text for r in ring}) == len(ring) and at.doc_id == ring[0].doc_id  # all in one ring
    ids = [r.doc_id for r in ring]
    turn = ids.index(max(ids)) + 1
    assert ids[turn:] + ids[:turn] == sorted(ids)
    assert sum(r.next_text is None for r in got) == (case == "shared null ids")


def test_fingerprints_equal_brute_force(spark):
    words = [f"wort{i}" for i in range(300)]
    rng = np.random.default_rng(4)
    rows = [(i * 7 % 151, " ".join(rng.choice(words, int(rng.integers(1, 60))))) for i in range(150)]
    rows += [(1000, rows[3][1]), (1001, None), (1002, "Ärger; wort1 WORT2"), (1003, "...")]
    order = sorted((d, t or "") for d, t in rows)

    def xx(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed=seed)

    def signed(h):
        return h - 2**64 if h >> 63 else h

    def own(text):
        return {w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}

    counts = collections.Counter(w for _, t in order for w in own(t))
    lexicon = {w for w, n in counts.items() if imatch.IDF_LOW <= np.log(len(order) / n) <= imatch.IDF_HIGH}

    def fingerprint(text):
        kept = sorted(signed(xx(w.encode())) for w in own(text) & lexicon)
        out = []
        for count, modulus, shift in imatch.SUBSETS:
            for j in range(count):
                h, part = 42, [t for t in kept if (t >> shift) % modulus == j]
                for t in part:
                    h = xx(struct.pack("<q", t), h)
                out.append(h & 0x7FFFFFFF if part else 0)
        return [*out, 0 if kept else xx(text.encode()) & 0x7FFFFFFF]

    def near(f, g):
        both = [x == y for x, y in zip(f, g, strict=True) if x or y]
        return sum(both) / len(both) if both else 0.0

    def text_of(f):
        return ".".join(f"{x:x}" if x else "" for x in f)

    want = set()
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        h = len(t) // 2
        f, g, n = fingerprint(t), fingerprint(t[: len(t) - h] + nxt[:h]), fingerprint(nxt)
        want.add((d, text_of(f), text_of(g), round(near(f, g), 9), round(near(f, n), 9)))
    got = imatch.fingerprint_edits(documents(spark, rows)).collect()
    assert {(r.doc_id, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == want


def brute_components(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(d, grams(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j][1])
            if a and sets[j][1] and 100 * both >= 75 * (len(a) + len(sets[j][1]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, s) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("tree,together,node_bits", [(4096, 512, 1 << 22), (8, 16, 1 << 22), (8, 512, 1 << 12), (4096, 64, 1 << 11)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, tree, together, node_bits):
    monkeypatch.setattr(ngramjoin, "TREE", tree)
    monkeypatch.setattr(ngramjoin, "TOGETHER", together)
    monkeypatch.setattr(ngramjoin, "NODE_BITS", node_bits)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(500)]
    base, rows = [list(rng.choice(words, int(rng.integers(8, 120)))) for _ in range(12)], []
    passage = list(rng.choice(words, 60))
    for i in range(220):
        own = list(base[i % 12])
        for _ in range(int(rng.integers(0, 6))):
            own[int(rng.integers(len(own)))] = str(rng.choice(words))
        if i % 4 == 0:
            own = passage + list(rng.choice(words, int(rng.integers(5, 60))))
        rows.append((1000 - i, " ".join(own)))
    rows += [(1, None), (2, ""), (3, "one two"), (4, "ONE\ttwo"), (5, "one two three four five"), (6, "Ä b c d e"), (7, "ä b c d e"), (8, LONG), (9, LONG + " end"), (5, "other text under one id"), (5, "other text under one id"), (10, rows[0][1]), (11, "x" * 100_000)]
    got = ngramjoin.near_duplicates(documents(spark, rows).repartition(4))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_components(rows)
    assert ngramjoin.near_duplicates(documents(spark, rows[:0])).count() == 0


def test_signature_trees_lose_no_pair():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    sets = []
    for i in range(150):
        own = set(rng.choice(pool, 60).tolist()) if i % 3 else set(sets[-1][: int(rng.integers(45, 60))]) | set(rng.choice(pool, 5).tolist()) if sets else {1}
        sets.append(sorted(own))
    sets.sort(key=len)
    tree = ngramjoin.SignatureTree([np.array(s, np.uint64) for s in sets], np.arange(len(sets)))
    found = {tuple(sorted((int(a), int(b)))) for i, j in tree.pairs(tree) for a, b in zip(i, j, strict=True)}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * (n := len(set(sets[i]) & set(sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - n)}
    assert links <= found and len(links) > 5 and len(found) < len(sets) ** 2 / 8


def test_bitmaps_of_nodes_part_what_sizes_leave():
    rng = np.random.default_rng(8)
    sets = []
    for i in range(600):
        own = rng.integers(0, 2**63, 230 + i % 9).astype(np.uint64) if i % 10 else np.append(sets[-1][20:], rng.integers(0, 2**63, 20).astype(np.uint64)) if sets else np.arange(230, dtype=np.uint64)
        sets.append(np.unique(own))
    order = np.lexsort(([x[0] for x in sets],))
    sets = [sets[i] for i in order]
    tree = ngramjoin.SignatureTree(sets, np.arange(len(sets)))
    found = {tuple(sorted((int(a), int(b)))) for i, j in tree.pairs(tree) for a, b in zip(i, j, strict=True)}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) > 190}
    assert links <= found and len(links) > 40
    seen = tree.seen
    # of 8,256 pairs of leaves nearly all are cut, most of them far above the leaves; 128 are a leaf and itself
    assert seen["bits"] > 2 * seen["leaves"] and seen["leaves"] < 300 and seen["pairs"] < 2000


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101)]
    got = {r.node: r.label for r in ngramjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[105] == got[101] == 100


def test_archives_come_back(spark):
    big = "<p>" + "content " * 50
    pages = [(5, "http://a/5", big), (2, "http://a/2?x=1\r\nEvil: 1%20", big), (9, None, big), (1, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", "WARC/1.1\r\n\r\n" * 30), (7, "u", "é" * 60), (2, "again", big), (8, "u", "x" * 500_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"n": F.lit(1), "digest": F.lit("d"), "first": F.lit(0)})
    got = warc.archive_round_trip(df).collect()
    assert {r.kind for r in got} == {"record"}
    want = sorted((str(p), len(b := (h or "").encode()), hashlib.sha256(b).hexdigest(), *(("revisit", "2") if h == big and p != 2 else ("response", "None"))) for p, _, h in pages)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    assert {r.url for r in got if r.page_id == 2} == {"http://a/2?x=1\r\nEvil: 1%20", "again"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def record(i, body):
    block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_salvage_finds_all_but_the_damaged(spark, tmp_path, pack):
    parts = [pack(record(i, f"body {i} ".encode() * 40)) for i in range(8)]
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = b"junk" + parts[0] + parts[1] + bytes(hurt) + parts[3] + parts[4][:50] + parts[5] + b"\x1f\x8b\x08tail" + parts[6] + parts[7][:-30]
    found = list(warc.salvage(data))
    assert [x.headers["warc-record-id"] for x in found if x.kind == "record"] == [f"<urn:page:{i}>" for i in (0, 1, 3, 5, 6)]
    assert [(x.offset, x.length) for x in found if x.kind == "gap"][0] == (0, 4)
    assert sum(x.length for x in found) == len(data) and sum(x.kind == "gap" for x in found) == 5
    (tmp_path / "a.warc").write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in rows if r.kind == "record") == [0, 1, 3, 5, 6] and all(r.reason for r in rows if r.kind == "gap")
    assert list(warc.salvage(b"")) == []


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 300)), f"s{i % 7}" if i % 9 else None) for i in range(900)] + [(5000, None, "s1"), (5000, None, "s1"), (None, "a b", "s2"), (5001, "big " * 9000, "tiny"), (5002, "a b c", "Ä"), (5003, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "bucket": F.lit(2), "n": F.lit(3)})
    got = mixing.mix_sources(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect())) and len(got) == len(rows)
    size, source = collections.Counter(), collections.defaultdict(set)
    for d, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight, fixed, goal = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(size.values())
    while over := [s for s in names if s not in fixed and (goal - sum(fixed.values())) * weight[s] / sum(weight[x] for x in names if x not in fixed) > 2 * size[s]]:
        fixed |= {s: 2.0 * size[s] for s in over}
    level = (goal - sum(fixed.values())) / sum(weight[x] for x in names if x not in fixed)
    taken, target = collections.Counter(), {}
    of = {(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for d, t, s in rows}
    for r in got:
        s = of[r.doc_id, r.size]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == size[s]
    for s in names:
        assert target[s] == pytest.approx(fixed.get(s, level * weight[s])), s
        assert abs(taken[s] - target[s]) <= 1 or s == "tiny"
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_budget_equals_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(60):
        sizes = np.unique(rng.integers(1, 40, 5))
        counts = rng.integers(1, 4, len(sizes))
        budget = int(rng.integers(0, int((sizes * counts).sum()) + 5))
        take = mixing.fit_budget(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        sums = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            sums = {x + k * s for x in sums for k in range(c + 1)}
        assert int((sizes * take).sum()) == max(x for x in sums if x <= budget)


def test_large_budgets_come_to_the_word():
    rng = np.random.default_rng(10)
    sizes = np.unique(np.append(rng.integers(3, 20_000, 400), [100_000, 700_000]))
    counts = rng.integers(1, 50, len(sizes))
    for share in (0.1, 0.5, 0.97):
        budget = int((sizes * counts).sum() * share)
        take = mixing.fit_budget(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and int((sizes * take).sum()) == budget
