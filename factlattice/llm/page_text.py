"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

Each block element is a node with features of its tag, its attributes' tokens and those of its
ancestors, its depth, its place among siblings, and the density of text, links and markup of its
subtree. Boosted trees give the chance that a node holds main text. A page is decoded as a tree: a node
is kept or dropped, a dropped node's descendants are dropped too, a kept node without text of its own
has a kept child, and of all such choices the likeliest is taken, so an ancestor never contradicts a
descendant.

The trees are trained here, on generated pages whose layouts vary (containers, class names, menus,
sidebars, notices, adverts, forms, comments, unclosed tags): a fixed number of them, from a fixed seed.
Defined results: null html counts as empty; a page without main text gives the empty text; pages of any
length and depth are read whole; repeated rows are read each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .page_dom import Node, parse
from .shingles import runs

PAGES, TREES, DEPTH, RATE = 800, 60, 4, 0.3
#: Attribute tokens that speak for a boilerplate or a content element, and groups of tags (fixed values).
SIDE = frozenset("nav navbar navigation menu menubar footer foot header masthead topbar sidebar side aside rail ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent notice gdpr alert comment comments respond reply discussion disqus related recommended share sharing social breadcrumb breadcrumbs newsletter subscribe signup popup modal overlay legal copyright pagination pager widget login search toolbar tags toc hidden skip contentinfo complementary form".split())
MAIN = frozenset("article content post entry main body story text page prose markdown articlebody maincontent document".split())
TAGS = [("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "dialog"), ("article", "main"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tr", "td", "th", "tbody", "thead"), ("div", "section", "center")]
_WHICH = {tag: i for i, group in enumerate(TAGS) for tag in group}
#: First words of names that only file a page under something, as blog software gives its articles (fixed values).
FILED = frozenset("tag category cat topic term label format status type author".split())
_TOKENS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def nodes_of(root: Node) -> list[Node]:
    out, stack = [], list(reversed(root.children))
    if root.blocks:
        out.append(root)
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def _named(attrs: str) -> tuple[int, int, int, int]:
    """Of an element's names (of class, id and role): how many of their words are side words, how many main words;
    how many names are side words throughout, and how many end with one (``ad-banner``, not ``ad-policy``).
    Names that file the page under something count for nothing beside others."""
    names = [_TOKENS.findall(_CAMEL.sub(" ", name).lower()) for name in attrs.split()]
    names = [n for n in names if n and not (len(n) > 1 and n[0] in FILED)]
    sides = [[t in SIDE for t in n] for n in names]
    return sum(map(sum, sides)), sum(t in MAIN for n in names for t in n), sum(map(all, sides)), sum(s[-1] for s in sides)


#: Features of a node beside its tag's group.
_MORE = 23


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """All nodes, parents first, and a row of features for each."""
    nodes = nodes_of(root)
    info: dict[int, list[float]] = {}
    own_chars: dict[int, int] = {}
    for node in reversed(nodes):  # children come before their parents
        chars = marks = 0
        for _, t in node.blocks:
            chars += len(t)
            marks += t.count(",") + t.count(".")
        s = [chars, node.link_chars, 1.0, marks, float(node.tag == "p"), float(len(node.blocks)), float(node.tag in ("h1", "h2"))]
        for child in node.children:
            s = [a + b for a, b in zip(s, info[id(child)])]
        info[id(node)] = s
        own_chars[id(node)] = chars
    total = max(1.0, sum(own_chars.values()))
    places = {id(child): i for node in (root, *nodes) for i, child in enumerate(node.children)}
    above: dict[int, tuple] = {id(root): (0, 0, 0, 0, 0)}
    x = np.zeros((len(nodes), len(TAGS) + _MORE))
    for row, node in zip(x, nodes):
        parent = node.parent if node.parent is not None else node
        depth, side, main, boxed, article = above.get(id(parent), (0, 0, 0, 0, 0))
        own_side, own_main, whole, last = _named(node.attrs) if node.attrs else (0, 0, 0, 0)
        which = _WHICH.get(node.tag, -1)
        chars, link, count, marks, paragraphs, blocks, heads = info[id(node)]
        kin = parent.children
        place = places.get(id(node), 0)
        own = own_chars[id(node)]
        if which >= 0:
            row[which] = 1.0
        row[len(TAGS) :] = (
            own_side, own_main, side, main, boxed, article, depth, place, len(kin), (place + 1) / (len(kin) + 1),
            math.log1p(chars), link / (chars + 1.0), chars / count, marks / (chars + 1.0), paragraphs, count, chars / total,
            math.log1p(own), chars / (blocks + 1.0), whole, last, heads, chars / max(1.0, info[id(parent)][0] if id(parent) in info else total),
        )
        # What an element's name says against it counts for its descendants only so far as the name is a side's.
        above[id(node)] = (depth + 1, side + last, main + own_main, boxed + (which in range(5)), article + (which == 5))
    return nodes, x


class Boosted:
    """Gradient-boosted regression trees for a yes-or-no target, on features cut at quantiles."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = 1.0) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0.03, 0.97, 24))) for c in x.T]
        bins = np.column_stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T)])
        self.start = math.log(y.mean() / (1 - y.mean()))
        self.trees = []
        raw = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            feature, cut_at, leaf = np.full(2**depth, -1), np.zeros(2**depth), np.zeros(2 ** (depth + 1))
            at = np.ones(len(y), dtype=int)
            for node in range(1, 2**depth):
                mine = np.flatnonzero(at == node)
                if len(mine) < 8:
                    continue
                gs, hs = g[mine].sum(), h[mine].sum()
                best, choice = 1e-3, None
                for j, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    b = bins[mine, j]
                    gl = np.cumsum(np.bincount(b, g[mine], len(cut) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[mine], len(cut) + 1))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, choice = gain[k], (j, k)
                if choice:
                    j, k = choice
                    feature[node], cut_at[node] = j, cuts[j][k]
                    at[mine] = 2 * node + (bins[mine, j] > k)
            # A node that isn't split passes its rows on to its left child.
            for node in range(1, 2**depth):
                if feature[node] < 0:
                    at[at == node] = 2 * node
            size = 2 ** (depth + 1)
            leaf = rate * np.bincount(at, g, size) / (np.bincount(at, h, size) + ridge)
            raw += leaf[at]
            self.trees.append((feature, cut_at, leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut_at, leaf in self.trees:
            at = np.ones(len(x), dtype=int)
            for _ in range(int(math.log2(len(feature)))):
                j = feature[at]
                at = 2 * at + ((j >= 0) & (x[rows, j] > cut_at[at]))
            out += leaf[at]
        return out


def decode(nodes: list[Node], raw: np.ndarray) -> list[str]:
    """Blocks of the kept nodes under the likeliest consistent choice, in page order."""
    raw = np.clip(raw, -12, 12)
    keep, drop = -np.logaddexp(0, -raw), -np.logaddexp(0, raw)
    index = {id(n): i for i, n in enumerate(nodes)}
    best_keep, all_drop = keep.tolist(), drop.tolist()
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        kids = [index[id(c)] for c in node.children]
        if kids:
            gone = sum(all_drop[k] for k in kids)
            gains = [best_keep[k] - all_drop[k] for k in kids]
            all_drop[i] += gone
            best_keep[i] += gone + sum(g for g in gains if g > 0)
            if max(gains) <= 0 and not node.blocks:
                best_keep[i] += max(gains)
        elif not node.blocks:
            best_keep[i] = -1e9  # nothing to keep
    blocks: list[tuple[int, str]] = []
    kept: dict[int, bool] = {}
    for i, node in enumerate(nodes):
        up = index.get(id(node.parent)) if node.parent is not None else None
        kept[i] = (up is None or kept[up]) and best_keep[i] > all_drop[i]
        if kept[i]:
            blocks += node.blocks
    return [t for _, t in sorted(blocks)]


def extract(model: Boosted, pages: list[str | None]) -> list[str]:
    parsed = [features(parse(p)) if p else ([], np.empty((0, len(TAGS) + _MORE))) for p in pages]
    sizes = [len(n) for n, _ in parsed]
    raw = model.raw(np.concatenate([x for _, x in parsed])) if sum(sizes) else np.empty(0)
    out, at = [], 0
    for (nodes, _), size in zip(parsed, sizes):
        out.append("\n".join(decode(nodes, raw[at : at + size])) if size else "")
        at += size
    return out


MARK = "\x02"


def training_page(r: random.Random) -> str:
    """A page whose main text begins with MARK in every block."""
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(1, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(1, 18).capitalize() + r.choice(".,.!?")
    prose = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 12])))
    box = lambda tag, names, inner: f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(names)}">{inner}</{tag}>'
    links = lambda: "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(r.randint(2, 9)))
    maybe = lambda p, x: x() if r.random() < p else ""
    plain = lambda: "".join(f"<p>{prose()}</p>" for _ in range(r.randint(1, 3)))

    def nav() -> str:
        inner = f"<ul>{links()}</ul>"
        return r.choice([f"<nav>{inner}</nav>", box("div", ["nav", "menu", "main-menu", "navbar", "breadcrumbs"], inner), box("ul", ["menu", "nav"], links()), f"<nav>{''.join(f'<a href=x>{word()}</a> ' for _ in range(5))}</nav>"])

    def advert() -> str:
        if r.random() < 0.2:
            return box("div", ["ad-" + word(), word() + "-ad", "promo-" + word(), "sponsored-" + word()], r.choice([sentence(), prose()]))
        return r.choice([box("div", ["ad", "ads", "advert", "ad-banner", "sponsored", "promo"], r.choice([sentence(), prose(), plain()])), box("aside", ["ad", "promo"], plain())])

    def notice() -> str:
        if r.random() < 0.2:
            return box(r.choice(["div", "section"]), ["cookie-" + word(), "consent-" + word(), word() + "-notice", "gdpr-" + word()], r.choice([prose(), sentence()]))
        return box(r.choice(["div", "section", "p"]), ["cookie-notice", "cookie", "notice", "consent-banner", "gdpr", "alert"], r.choice([prose(), sentence()]))

    def comments() -> str:
        one = lambda: r.choice([box("div", ["comment", "reply"], f"<p>{prose()}</p>"), f"<li><p>{prose()}</p></li>"])
        inner = maybe(0.6, lambda: f"<h3>{words(1, 3)}</h3>") + "".join(one() for _ in range(r.randint(1, 5)))
        return box(r.choice(["section", "div", "ol"]), ["comments", "comment-list", "discussion", "respond"], inner)

    def sidebar() -> str:
        inner = r.choice([f"<h3>{words(1, 3)}</h3><ul>{links()}</ul>", plain(), f"<p>{sentence()}</p>"])
        return r.choice([f"<aside>{inner}</aside>", box("div", ["sidebar", "side-bar", "related", "widget", "rail"], inner), box("aside", ["sidebar", "related"], inner)])

    def form() -> str:
        return r.choice(["<form action=x>", '<form class="newsletter">']) + f"<p>{sentence()}</p><label>{word()}</label><input name=q><button>{word()}</button></form>"

    side_words = sorted(SIDE)

    def turned() -> str:
        """A name of main text that holds a side word: what the text is about, or how it is filed."""
        w = r.choice(side_words)
        return r.choice([f"{w}-{word()}", f"{w}-{word()}", f"{w}_{word()}-{word()}", f"{r.choice(sorted(FILED))}-{w}"])

    def turned_names() -> str:
        """Names of an article as blog software gives them, in a class or an id."""
        filed = " ".join(f"{r.choice(sorted(FILED))}-{r.choice([word(), r.choice(side_words)])}" for _ in range(r.randint(1, 4)))
        return r.choice([f'class="post {filed}"', f'class="post-{r.randint(1, 99)} post type-post hentry {filed}"', f'class="{turned()}"', f'id="{turned()}"', f'class="content" id="{turned()}"', f'class="{filed}"'])

    def block() -> str:
        text = MARK + prose()
        if r.random() < 0.1:
            return "<ul>" + "".join(f"<li>{MARK}{sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if r.random() < 0.08:  # an article's own lists of links, on their own or after words
            lead = r.choice(["", "", f"{MARK}{words(1, 5)}: "])
            item = lambda: r.choice([f'{MARK}<a href="/{word()}">{words(1, 5)}</a>', f'{lead}<a href="/{word()}">{words(1, 4)}</a> {sentence()}' if lead else f'{MARK}<a href="x">{words(1, 3)}</a>, {words(1, 8)}'])
            tag = r.choice(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(1, 6))) + f"</{tag}>"
        if r.random() < 0.04:
            return f'<figure><img src="x.png"><figcaption>{MARK}{r.choice([sentence(), prose()])}</figcaption></figure>'
        if r.random() < 0.04:
            return "<dl>" + "".join(f"<dt>{MARK}{words(1, 3)}</dt><dd>{MARK}{sentence()}</dd>" for _ in range(r.randint(1, 4))) + "</dl>"
        if r.random() < 0.04:
            tag = r.choice(["section", "section", "div"])
            return f"<{tag}{r.choice(['', f' class={turned()}', f' id={turned()}'])}><h3>{MARK}{words(1, 5)}</h3>" + "".join(f"<p>{MARK}{prose()}</p>" for _ in range(r.choice([1, 1, 2, 4]))) + f"</{tag}>"
        if r.random() < 0.03:
            return f'<p>{MARK}<a href="/x">{words(1, 6)}</a></p>'
        if r.random() < 0.05:
            return "<table>" + "".join(f"<tr><td>{MARK}{words(1, 3)}</td><td>{MARK}{words(1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if r.random() < 0.1:
            return f"<h{r.choice('234')}>{MARK}{words(1, 7)}</h2>"
        return r.choice([f"<p>{text}</p>"] * 6 + [f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>", f"<blockquote>{text}</blockquote>", f'<p>{text} <a href="/x">{words(1, 4)}</a> {sentence()}</p>', f"<pre>{text}</pre>"])

    side = [advert, notice, comments, sidebar, form, nav]
    title = r.choice(["h1", "h1", "h2"])
    head = f"<{title}>{MARK}{words(1, 10)}</{title}>"
    byline = lambda: f'<p class="{r.choice(["byline", "meta", "author", "date", "lead"])}">{MARK}{words(2, 8)}</p>'
    head = r.choice([head] * 4 + [f"<header>{head}</header>", f"<header>{head}{byline()}</header>", f'<header class="{r.choice(["entry-header", "post-header", "article-header"])}">{head}{maybe(0.5, byline)}</header>', head + byline(), ""])
    inner = head + "".join(block() + maybe(0.06, lambda: r.choice(side)()) for _ in range(r.choice([1, 1, 2, 3, 5, 9, 16])))
    body = r.choice([lambda: f"<article>{inner}</article>"] * 4 + [lambda: f"<main>{inner}</main>", lambda: f"<main><article>{inner}</article></main>", lambda: box("div", ["content", "post", "entry-content", "article-body", "main", "story", "text", "c1", "wrap"], inner), lambda: box("section", ["content", "main", "post"], inner), lambda: f"<div><div>{inner}</div></div>"])()
    if r.random() < 0.3:
        tag = r.choice(["article", "article", "div", "section", "main"])
        body = f"<{tag} {turned_names()}>{inner}</{tag}>"
    page = maybe(0.6, nav) + maybe(0.3, lambda: r.choice([f"<header><p>{sentence()}</p>{maybe(0.5, nav)}</header>", box("div", ["header", "masthead", "topbar"], f"<h2>{words(1, 3)}</h2><p>{sentence()}</p>")]))
    page += "".join(maybe(0.25, f) for f in (advert, notice, sidebar, form)) + "<!-- x -->" + body + "".join(maybe(0.25, f) for f in (comments, sidebar, advert, form, notice))
    page += maybe(0.8, lambda: r.choice([f"<footer>&copy; {prose()}</footer>", f"<footer><p>{sentence()}</p><ul>{links()}</ul></footer>", box("div", ["footer", "copyright", "legal"], prose())]))
    if r.random() < 0.3:
        page = box("div", ["wrapper", "container", "page", "layout", "row"], page)
    close = "" if r.random() < 0.2 else "</body></html>"
    return f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>var a='<p>';</script></head><body>{page}{close}"


@functools.lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = 4) -> Boosted:
    r = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, x = features(parse(training_page(r)))
        main: dict[int, bool] = {}
        for node in reversed(nodes):
            main[id(node)] = any(MARK in t for _, t in node.blocks) or any(main[id(c)] for c in node.children)
        xs.append(x)
        ys += [float(main[id(n)]) for n in nodes]
    return Boosted().fit(np.concatenate(xs), np.array(ys))


def texts_of(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast(trained())  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            html_ = batch.column("html").to_pylist()
            texts: list[str] = []
            for start, end in runs(html_, 1 << 20):
                texts += extract(model, html_[start:end])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(common.tidy(run), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return texts_of(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
