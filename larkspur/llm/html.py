"""Main text of web pages by site style trees."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import rows_of, staged

#: Pages of a site that must share a node before it is judged.
LEAST_PAGES = 5
#: A site's texts fall into two classes if their mean importances differ by so much, with so wide a gap between them.
CLASSES_APART, CLASS_GAP = 0.06, 0.02
#: Share of a node's importance that its children keep, by level.
DECAY = 0.9

# fixed values: HTML's element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head", "title", "legend"}
#: An opening tag ends an open one of these, up to the given parents.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
# fixed values: elements, roles and words in class or id that never hold an article's text
DROP = frozenset("head script style noscript template iframe object embed svg canvas audio video nav aside footer form button select textarea input dialog menu noembed noframes xmp math map title".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side "
    "aside footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations pagination pager comment comments commentlist reply replies respond disqus widget toolbar skip form search".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
# fixed values: elements that hold an article's own text, whose class and id name its subject
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p li dt dd td th caption figcaption blockquote pre".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*|[^>]*)>|<[a-zA-Z/][^>]*\Z",
    re.S,
)
#: A whole attribute, name then value, so that nothing is looked for inside another's name or value.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: The attributes that tell what an element is for.
TELLING = frozenset("class id role hidden style aria-hidden".split())
_WORDS = re.compile(r"[a-z]+")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


#: Why an element is noise: by its kind, or only by a word in its class or id.
KIND, WORD = 1, 2


class Node:
    __slots__ = ("tag", "key", "parent", "noise", "article", "children", "sign")

    def __init__(self, tag: str, sign: str, parent: Node | None, noise: int, article: str | None):
        self.tag, self.sign, self.parent, self.noise, self.article, self.children = tag, sign, parent, noise, article, []
        self.key = _hash(f"{parent.key if parent else 0}/{sign}")


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The page's block elements and its text blocks (element, text) in page order; white space is one space each."""
    root = Node("#root", "#root", None, 0, None)
    nodes, blocks, buffer = [root], [], []
    stack: list[tuple[str, Node]] = [("#root", root)]
    places: dict[str, list[int]] = {}  # of each open tag in the stack
    open_blocks: list[int] = []

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((stack[-1][1], text))

    def push(name: str, own: Node) -> None:
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            open_blocks.append(len(stack))
        stack.append((name, own))

    def cut(at: int) -> None:
        while len(stack) > at:
            name, _ = stack.pop()
            places[name].pop()
            if name in BLOCK:
                open_blocks.pop()

    def close(at: int) -> None:
        flush()
        cut(at)

    def place(name: str) -> int:
        return (places.get(name) or (0,))[-1]

    def last(names: tuple[str, ...], until: tuple[str, ...]) -> int | None:
        """Where one of the names is open, above all of `until`."""
        at = max(map(place, names))
        return at if at and at >= max(map(place, until), default=0) else None

    pos = 0
    for m in iter(lambda: _TOKEN.search(html, pos), None):
        if m.start() > pos:
            buffer.append(unescape(html[pos : m.start()]))
        pos = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"] is not None:
                buffer.append(m["cdata"])
            continue
        name = name.lower()
        if m["end"]:
            i = place(name)
            if i and (name in BLOCK or not open_blocks or i > open_blocks[-1]):
                if name in BLOCK or stack[i][1] is not stack[i - 1][1]:
                    flush()
                cut(i)
            continue
        if name in BLOCK:
            flush()
        if name in CLOSES_P and (i := last(("p",), ("table", "td", "th", "button"))) is not None:
            close(i)
        if name in IMPLIED and (i := last(*IMPLIED[name])) is not None:
            close(i)
        above = stack[-1][1]
        attrs = _attributes(m["attrs"]) if m["attrs"] else {}
        if name == "br":
            buffer.append(" ")
        noise, article = _prior(name, attrs, above)
        if name in VOID or m["attrs"].endswith("/") and name in ("script", "iframe"):
            continue
        if name in BLOCK or noise and noise != above.noise:
            flush()
            names = " ".join(sorted(set(_WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))))
            own = Node(name, f"{name}.{names}", above, noise, article)
            above.children.append(own.sign)
            nodes.append(own)
        else:
            own = above
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, pos)
            raw_end = stop.start() if stop else len(html)
            if name == "title" or name == "textarea":
                push(name, own)
                buffer.append(unescape(html[pos:raw_end]))
                close(len(stack) - 1)
            close_tag = html.find(">", raw_end)
            pos = close_tag + 1 if stop and close_tag >= 0 else len(html)
            continue
        push(name, own)
    if pos < len(html):
        buffer.append(unescape(html[pos:]))
    flush()
    return nodes, blocks


def _attributes(text: str) -> dict[str, str]:
    """The telling attributes; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        if (name := name.lower()) in TELLING:
            out.setdefault(name, "".join(values))
    return out


def _prior(name: str, attrs: dict[str, str], above: Node) -> tuple[int, str | None]:
    """Why the element is noise, and which of article and main it lies in."""
    inside = "article" if name == "article" or above.article == "article" else "main" if name == "main" or above.article else None
    if above.noise == KIND:
        return KIND, above.article
    if name in DROP or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return KIND, above.article
    if name == "header" and not above.article:
        return KIND, above.article
    noise = above.noise
    if attrs:
        names = attrs.get("class", "").lower(), attrs.get("id", "").lower()
        if attrs.get("role", "").lower() in DROP_ROLES and name not in ("article", "main", "body", "html"):
            return KIND, above.article
        if name in ("article", "main", "body", "html"):
            if set(_WORDS.findall(" ".join(names))) & COMMENT_WORDS and name == "article":
                return KIND, above.article
        elif _named_noise(name, *names, bool(above.article)):
            # a reader's comment is as unlike others as an article's text: no importance tells them apart
            comment = set(_WORDS.findall(" ".join(names))) & COMMENT_WORDS
            noise = KIND if comment else WORD
    return noise, above.article if noise else inside


def _named_noise(name: str, classes: str, own_id: str, inside: bool) -> bool:
    """Whether class or id tell noise. Ids of prose and sections are slugs of their headings.

    Inside article and main only whole class names of other elements count, and whole ids of comments; elsewhere any
    word of a class or id does, but of a section's id only the whole.
    """
    if inside:
        return name not in PROSE and bool(set(classes.split()) & (DROP_WORDS - {"header"}) or name != "section" and own_id in COMMENT_WORDS)
    if name in PROSE:
        return bool(set(classes.split()) & DROP_WORDS)
    slug = {own_id} if name == "section" else set(_WORDS.findall(own_id))
    return bool((set(_WORDS.findall(classes)) | slug) & DROP_WORDS)


def _host(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/?#]*:?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page adds to its site's tree: the styles and contents of every node, once a batch for each page.

    Inside article and main their texts stand for the page, so an article copied to many pages is one.
    """
    for batch in batches:
        seen: set[tuple] = set()
        for host, html in rows_of(batch, "host", "html"):
            nodes, blocks = parse(html)
            page, copy = _hash(html), _hash("\n".join(t for x, t in blocks if x.article and not x.noise))
            seen |= {(host, x.key, x.parent.key if x.parent else 0, 0, _hash(" ".join(dict.fromkeys(x.children))), copy if x.article else page) for x in nodes}
            seen |= {(host, x.key, x.parent.key if x.parent else 0, 1, _hash(text), copy if x.article else page) for x, text in blocks}
        cols = list(zip(*seen, strict=True)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "node", "parent", "kind", "value", "page"])


def _importance(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one site and the importance of their branches.

    A node's own importance is the entropy of its presentation styles, or of its contents where it has texts, to
    the base of its pages (1 if it is on one page). It fades into the mean importance of its children by DECAY a
    level. A branch is as important as its most important node.
    """
    own: dict[int, float] = {}
    pages: dict[int, float] = {}
    children: dict[int, list[int]] = {}
    for r in rows.itertuples():
        pages[r.node] = max(r.styles_n, r.texts_n)
        parts = [h / math.log(n) if n > 1.5 else 1.0 for n, h in ((r.styles_n, r.styles_h), (r.texts_n, r.texts_h)) if n > 0]
        own[r.node] = parts[-1] if r.texts_n > 0 else parts[0]
        if r.parent:
            children.setdefault(r.parent, []).append(r.node)
    roots = [n for n in own if n not in {c for cs in children.values() for c in cs}]
    order, level = [], {}
    todo = [(n, 0) for n in roots]
    while todo:
        n, depth = todo.pop()
        order.append(n)
        level[n] = depth
        todo += [(c, depth + 1) for c in children.get(n, ())]
    whole, most = {}, {}
    for n in reversed(order):
        below = [c for c in children.get(n, ())]
        fade = DECAY ** (level[n] + 1)
        whole[n] = own[n] if not below else (1 - fade) * own[n] + fade * sum(whole[c] * pages[c] for c in below) / sum(pages[c] for c in below)
        most[n] = max([whole[n], *(most[c] for c in below)])
    known = [n for n in order if most[n] < 1 and pages[n] >= LEAST_PAGES]
    least = boilerplate_below([own[r.node] for r in rows.itertuples() if r.texts_n >= LEAST_PAGES])
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "nodes": pd.Series([known], dtype=object), "weights": pd.Series([[most[n] for n in known]], dtype=object), "least": [least]})


def boilerplate_below(importances: list[float]) -> float | None:
    """The importance that parts a site's texts in two classes with the largest variance between them, None if there is one class.

    How much a site's chrome varies differs from site to site, but its articles vary more.
    """
    x = sorted(importances)
    best, cut, below, total = 0.0, None, 0.0, math.fsum(x)
    for i in range(1, len(x)):
        below += x[i - 1]
        low, high = below / i, (total - below) / (len(x) - i)
        between = i * (len(x) - i) * (high - low) ** 2
        if between > best and high - low >= CLASSES_APART and x[i] - x[i - 1] >= CLASS_GAP:
            best, cut = between, (x[i] + x[i - 1]) / 2
    return cut


def site_style_trees(pages: DataFrame) -> DataFrame:
    """host, nodes, weights, least: the nodes of each site's style tree, the importance of their branches, where below 1, and that below which they are boilerplate.

    Pages of a host are merged: nodes are elements by their path of tags and class words. Copies of one page, or of
    one article, count once. All counting is in aggregates that start inside the scanning tasks; a site meets in one
    task only as its tree, one row a node, of those nodes that LEAST_PAGES pages share.
    """
    counted = pages.mapInArrow(_features, "host string, node long, parent long, kind int, value long, page long")
    values = counted.groupBy("host", "node", "parent", "kind", "value").agg(F.count_distinct("page").alias("n"))
    n = F.col("n").cast("double")
    kinds = [(name, F.when(F.col("kind") == k, n)) for k, name in enumerate(("styles", "texts"))]
    sums = [x for name, v in kinds for x in (F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{name}_n"), F.coalesce(F.sum(v * F.log(v)), F.lit(0.0)).alias(f"{name}_l"))]
    nodes = values.groupBy("host", "node", "parent").agg(*sums).filter(F.greatest("styles_n", "texts_n") >= LEAST_PAGES)
    entropy = [F.when(F.col(f"{k}_n") > 0, F.log(f"{k}_n") - F.col(f"{k}_l") / F.col(f"{k}_n")).otherwise(0.0).alias(f"{k}_h") for k in ("styles", "texts")]
    return nodes.select("host", "node", "parent", "styles_n", "texts_n", *entropy).groupBy("host").applyInPandas(_importance, "host string, nodes array<long>, weights array<double>, least double").filter("size(nodes) > 0")


def unimportant(nodes: list[Node], weights: dict[int, float], least: float | None) -> set[int]:
    """ids of the nodes that go by the site's tree: branches of low importance with all below them.

    Headings, and bare prose inside article and main or bare paragraphs anywhere, don't go on their own: a site's
    own texts and its boilerplate share them. What the tree doesn't know is rare on the site and follows its parent.
    """
    gone: set[int] = set()
    if least is None:
        return gone
    for x in nodes:  # parents come before their children
        held = x.tag in HEADINGS or x.sign == "p." or x.article and x.tag in PROSE and x.sign == f"{x.tag}."
        if id(x.parent) in gone or weights.get(x.key, 1.0) < least and not held:
            gone.add(id(x))
    return gone


def main_text(html: str, weights: dict[int, float] | None = None, least: float | None = None) -> str:
    """The page's article: its text blocks joined by newlines, without branches that the site's tree finds unimportant and without noise.

    The tree decides first, inside article and main too. On a site whose tree tells two classes of texts apart, words
    in class and id count for nothing but comments; elsewhere they tell noise. Elements that are noise by their kind
    go on every site.

    If the page has article elements, they count alone, else the main element, else all of the body; but main counts
    whole if its texts beside the articles weigh more than they, and so does the body on a site whose tree is known.
    A text weighs its length times its branch's importance.
    """
    weights = weights or {}
    nodes, blocks = parse(html)
    gone = unimportant(nodes, weights, least)

    def noise(x: Node) -> bool:
        return x.noise == KIND or x.noise == WORD and least is None

    kept = [(x, t) for x, t in blocks if not noise(x) and id(x) not in gone]
    mass = dict.fromkeys(("article", "main", None), 0.0)
    for x, t in kept:
        mass[x.article] += len(t) * weights.get(x.key, 1.0)
    inside = {x.article for x in nodes if not noise(x)}
    if "article" in inside and mass["main"] <= mass["article"] and not (least is not None and "main" not in inside and mass[None] > mass["article"]):
        kept = [(x, t) for x, t in kept if x.article == "article"]
    elif "main" in inside:
        kept = [(x, t) for x, t in kept if x.article]
    return "\n".join(t for _, t in kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null html counts as empty and gives empty text; pages with a null or odd url have no site and so no tree.
    Repeated rows are pages of their own. An empty table gives no rows. Extra columns are ignored. Pages of any
    length are read whole; nested elements cost memory in proportion.
    """
    rows = pages.select("page_id", "url", _host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    trees = staged(site_style_trees(rows.filter("host <> ''").select("host", "html")), "style-trees")
    # a small table of trees is broadcast by its size on disk, else the join is shuffled and AQE splits hot sites
    joined = rows.join(trees, "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, tree = None, {}
        for batch in batches:
            texts = []
            nodes, weights = batch.column(batch.schema.get_field_index("nodes")), batch.column(batch.schema.get_field_index("weights"))
            for i, (host, html, least) in enumerate(rows_of(batch, "host", "html", "least")):
                if host != site:  # pages of a host mostly follow each other: its tree is built once for them
                    site, tree = host, dict(zip(nodes[i].as_py() or (), weights[i].as_py() or (), strict=True))
                texts.append(main_text(html, tree, least))
            n = batch.schema.get_field_index
            yield pa.RecordBatch.from_arrays([batch.column(n("page_id")), batch.column(n("url")), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "host", "html", "nodes", "weights", "least").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
