"""Attributes by whole names, linear time on hostile pages and archives, style trees against a brute-force version."""

import collections
import hashlib
import math
import time

import pytest
from pyspark.sql import functions as F

from larkspur.llm import html, warc


@pytest.mark.parametrize(
    "page,want",
    [
        ('<article><p title="a hidden gem">Kept text</p><p>Second</p></article>', "Kept text\nSecond"),
        ('<article><div data-hidden="false">Kept</div></article>', "Kept"),
        ('<article><div data-id="comments">Kept</div></article>', "Kept"),
        ('<article><p>One <span title="hidden meaning">two</span> three</p></article>', "One two three"),
        ("<article><p data-role='navigation' xclass=sidebar>Kept</p></article>", "Kept"),
        ("<article><p>Kept</p><p hidden>Gone</p><p HIDDEN=''>Gone</p><div aria-hidden = 'true'>Gone</div><div style='Display: none'>x</div></article>", "Kept\nx"),
        ("<article><p>Kept</p><p class=a hidden/>Gone</article>", "Kept"),
        ("<div id=comments id=x><p>Gone</p></div><p>Kept</p>", "Kept"),
    ],
)
def test_attributes_count_by_whole_names(page, want):
    assert html.main_text(page) == want


def test_hostile_pages_take_linear_time():
    for piece in ("<!-", "<!", "<a ", '<a b="', "<p title='", "<a b= ", "&", "<a =", "<p hidden ", "<p a=b "):
        began = time.time()
        html.parse(piece * (300_000 // len(piece)))
        assert time.time() - began < 10, piece


def test_classes_of_a_large_site_are_parted_in_linear_time():
    began = time.time()
    cut = html.boilerplate_below([i / 10**6 * 0.4 for i in range(500_000)] + [0.9 + i / 10**7 for i in range(500_000)])
    assert 0.4 < cut < 0.9 and time.time() - began < 10


def brute_tree(pages):
    """Own importance of every node that LEAST_PAGES pages share: entropy over distinct pages of its styles or its contents."""
    held = collections.defaultdict(lambda: collections.defaultdict(set))
    for page in pages:
        nodes, blocks = html.parse(page)
        copy = "\n".join(t for x, t in blocks if x.article and not x.noise)
        for x in nodes:
            held[x.key, 0][" ".join(dict.fromkeys(x.children))].add(copy if x.article else page)
        for x, t in blocks:
            held[x.key, 1][t].add(copy if x.article else page)
    out = {}
    for key in {k for k, _ in held}:
        counts = [[len(v) for v in held[key, kind].values()] for kind in (0, 1)]
        if max(map(sum, counts)) >= html.LEAST_PAGES:
            own = counts[1] if sum(counts[1]) else counts[0]
            n = sum(own)
            out[key] = -sum(c / n * math.log(c / n) for c in own) / math.log(n) if n > 1 else 1.0
    return out


def pages_of_a_site(n=24):
    """Chrome in unnamed divs inside the article, of three wordings, which no list of tags or names can tell."""
    menus = ["Home and all our pages", "Everything we ever wrote", "Ask the editors by letter"]
    said = [f"Story {i} tells of {['rivers', 'towers', 'gardens', 'bridges'][i % 4]} number {i * 37} and of nothing else." for i in range(n)]
    return [f"<html><body><article><div><span>{menus[i % 3]}</span></div><h1>Title {i}</h1><p>{said[i]}</p><section>More about {i}: {said[-i]}</section><div><b>Printed by the same house since 1900</b></div></article></body></html>" for i in range(n)], said


def test_the_tree_takes_chrome_that_no_list_knows(spark):
    pages, said = pages_of_a_site()
    df = spark.createDataFrame([(i, f"http://site.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").withColumn("host", F.lit("x"))
    for r in html.extract_main_text(df.repartition(3)).collect():
        lines = r.text.split("\n")
        assert lines[:2] == [f"Title {r.page_id}", said[r.page_id]] and "Printed" not in r.text and "Home and all" not in r.text and len(lines) == 3
        assert "Printed" in html.main_text(pages[r.page_id])  # without the tree it stays


def test_the_tree_equals_brute_force(spark):
    pages, _ = pages_of_a_site()
    pages += pages[:3] + ["<html><body><p>Lone page</p></body></html>"]
    tree = html.site_style_trees(spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(3)).first()
    want = brute_tree(pages)
    weights = dict(zip(tree.nodes, tree.weights))
    assert set(weights) <= set(want)
    leaves = [k for k in weights if all(x.parent is None or x.parent.key != k for p in pages for x in html.parse(p)[0])]
    assert leaves and all(weights[k] == pytest.approx(want[k]) for k in leaves)
    assert min(want.values()) < tree.least < 1


def record(payload=b"hello " * 30, extra=b"", digest=None):
    digest = digest or b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: " + digest + b"\r\n" + extra + b"Content-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


@pytest.mark.parametrize("digest", [b"shake_128:ab", b"shake_256:", b"blake2b:00", b"crc32:1", b":", b"nothing", b"SHA-256:" + hashlib.sha256(b"hello " * 30).hexdigest().encode()])
def test_odd_digests_never_raise_nor_condemn(digest):
    assert [x.kind for x in warc.salvage(record() + record(digest=digest))] == ["record", "record"]


def test_false_digests_condemn():
    for digest in (b"sha256:00", b"sha-1:00", b"MD5:00"):
        assert [x.kind for x in warc.salvage(record() + record(digest=digest) + record())] == ["record", "gap", "record"]


def test_folded_headers_are_one_line():
    found = list(warc.salvage(record(extra=b"X-Note: one\r\n  two\r\n\tthree\r\n")))
    assert [x.kind for x in found] == ["record"] and found[0].headers["x-note"] == "one two three"


def test_salvage_takes_linear_time():
    for junk in (b"WARC/1.1\r\n" * 800_000, b"\x1f\x8b\x08" * 300_000, b"WARC/1.1\r\nContent-Length: 9\r\n\r\n" * 60_000):
        began = time.time()
        found = list(warc.salvage(junk + record()))
        assert time.time() - began < 10 and [x.kind for x in found] == ["gap", "record"] and found[0].length == len(junk)


def test_fuzzed_headers_never_raise():
    import random

    rng = random.Random(8)
    whole = record() * 3
    for _ in range(3000):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.choice(b"\r\n: \x00\xff9zW\x1f")
        assert sum(x.length for x in warc.salvage(bytes(data))) == len(data)
