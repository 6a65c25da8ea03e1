"""HTML extraction: a tree-structured graphical model over the block elements of a page.

Method: a tolerant parser turns the page into a tree of block elements with their text runs. Every node is a
binary variable (content or not) with a log-linear potential over tag, class and id words, role, text length,
link density and punctuation; every parent-child edge has a 2 x 2 potential, one table below page wrappers and
one below other nodes. Sum-product messages, children to parents and back, give each node's marginal; runs of
nodes at 0.5 or more are the text. The potentials are trained by gradient ascent on the exact log-likelihood
of labelled pages, which ``labelled_pages`` writes from seeded templates (elements carry ``data-content``).

Parsing and messages are iterative and linear in the page, so depth and length are not bounded.

Defined results: null or empty html gives an empty text; markup that never closes is closed at the end;
comments, scripts, styles, templates and form controls never count, nor does what scripts are replaced by
(``noscript``); rows are independent, so ties, repeated
rows, null ids, empty tables and extra columns need no care.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

NAME = re.compile(r"[a-zA-Z][^\s>/]*")
#: What matters inside a tag: its end, and values. A quote opens a string only as the start of a value.
STOP = re.compile(r"""=\s*(?:(["'])|[^\s>"'][^\s>]*)|>""")
#: Raw elements that may be nested or self-closed; ``/`` after an unquoted value is a part of it.
FOREIGN = ("svg", "math")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
COMMENT_END = re.compile("--!?>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg canvas select button noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math maction menclose merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover nobr object q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul xmp".split())
#: Elements that close an open one of their family, and those that begin a new scope for families.
FAMILY = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3}
SCOPES = {"ul": (0,), "ol": (0,), "menu": (0,), "dl": (1,), "table": (0, 1, 2, 3), "tr": (3,)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# Words in class and id attributes that tell boilerplate or content.
BAD_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer disqus footer form gdpr header login masthead menu meta modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo related reply search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar warning widget".split())
GOOD_WORDS = frozenset("article articlebody body content entry main post story text page-content post-content".split())
BAD_TAGS = frozenset(("nav", "aside", "footer", "form", "menu", "dialog"))
WRAPPERS = frozenset(("#root", "html", "body"))
TAGS = ("#root", "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "dl", "dd", "dt", "fieldset", "address", "center", "menu", "dialog")
_TAG = {t: i for i, t in enumerate(TAGS)}
_BASE = len(TAGS) + 1
FEATURES = _BASE + 24


class Node:
    __slots__ = ("attrs", "links", "parent", "raw", "runs", "size", "stops", "tag", "words")

    def __init__(self, tag: str, parent: int, raw: str) -> None:
        self.tag, self.parent, self.raw = tag, parent, raw
        self.runs: list[int] = []
        self.size = self.links = self.stops = 0


class Scanner:
    """Markup of a page, in one pass: each character is looked at a bounded number of times.

    A tag ends at the first ``>`` outside its quoted values. Where there is none, this and all later tags end at their
    first ``>``; markup after the last ``>`` of the page is text, and a comment that never ends takes the rest."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.plain = False
        self.last_of: set[str] = set()

    def tag_end(self, at: int) -> int:
        """Where the tag whose attributes start at ``at`` has its ``>``."""
        j = at
        while not self.plain and (m := STOP.search(self.page, j)):
            if m[0] == ">":
                return m.start()
            j = m.end()
            if m[1]:
                if m.start(1) >= self.quotes[m[1]]:
                    break
                j = self.page.index(m[1], j) + 1
        self.plain = True
        return self.page.index(">", at)

    def raw_end(self, tag: str, at: int) -> tuple[int, int]:
        """Start and end of the end tag of a raw element whose content starts at ``at``."""
        depth = 1
        for m in re.compile(rf"<(/?){tag}(?=[\s>/])", re.I | re.A).finditer(self.page, at):
            if m.start() >= self.last:
                break
            end = self.page.index(">", m.start())
            if m[1]:
                depth -= 1
            elif tag in FOREIGN and not SELF_CLOSED.search(self.page[max(m.end(), end - 2) : end]):
                depth += 1
            if not depth:
                return m.start(), end + 1
        return len(self.page), len(self.page)

    def closed_alone(self, tag: str, at: int) -> bool:
        """Whether a raw tag that ends in a ``/`` of its own has no content: foreign ones; of others, as no end tag comes before the
        next of the kind, so that the slash was meant."""
        if tag in FOREIGN or tag in self.last_of:
            return True
        m = re.compile(rf"<(/?){tag}(?=[\s>/])", re.I | re.A).search(self.page, at)
        if not m:
            self.last_of.add(tag)
        return not m or not m[1]

    def tokens(self) -> Iterator[tuple[str, str, str]]:
        """(kind, value, attributes): ``text``, ``start`` and ``end`` of elements with names in lower case, ``raw``
        (the content of ``xmp``, which has no markup)."""
        page, at = self.page, 0
        while at < len(page):
            start = page.find("<", at)
            if start < 0 or start > self.last and not page.startswith("<!--", start):
                yield "text", page[at:], ""
                return
            mark = page[start + 1 : start + 2]
            if mark in ("!", "?"):
                if start > at:
                    yield "text", page[at:start], ""
                if page.startswith("<!--", start):
                    end = COMMENT_END.search(page, start + 2)
                    if not end:
                        return
                    at = end.end()
                else:
                    at = page.index(">", start) + 1
            elif m := NAME.match(page, start + 1 + (mark == "/")):
                if start > at:
                    yield "text", page[at:start], ""
                tag, end = m[0].lower(), self.tag_end(m.end())
                at = end + 1
                if mark == "/":
                    yield "end", tag, ""
                    continue
                raw = page[m.end() : end]
                if tag in RAW or tag == "xmp":
                    stop = after = at
                    if not SELF_CLOSED.search(raw) or not self.closed_alone(tag, at):
                        stop, after = self.raw_end(tag, at)
                    if tag == "xmp":
                        yield "start", tag, raw
                        yield "raw", page[at:stop], ""
                        yield "end", tag, ""
                    else:
                        yield "start", tag, raw
                    at = after
                else:
                    yield "start", tag, raw
            else:
                yield "text", page[at : start + 1], ""
                at = start + 1


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements in page order (parents first), and the text runs as (node, text)."""
    nodes, stack, runs, piece = [Node("#root", -1, "")], [0], [], []
    families, opened = [(-1, -1, -1, -1)], Counter()
    in_link, in_head = 0, False

    def flush() -> None:
        if piece:
            if text := " ".join("".join(piece).split()):
                runs.append((stack[-1], text))
                nodes[stack[-1]].size += len(text)
                nodes[stack[-1]].stops += sum(map(text.count, ".!?,;"))
            piece.clear()

    def close(depth: int) -> None:
        flush()
        opened.subtract(nodes[i].tag for i in stack[depth:])
        del stack[depth:], families[depth:]

    def add(tag: str, raw: str) -> None:
        flush()
        family = families[-1]
        if tag in FAMILY or tag in SCOPES:
            family = list(family)
            for f in SCOPES.get(tag, ()):
                family[f] = -1
            if tag in FAMILY:
                family[FAMILY[tag]] = len(stack)
            family = tuple(family)
        nodes.append(Node(tag, stack[-1], raw))
        stack.append(len(nodes) - 1)
        families.append(family)
        opened[tag] += 1

    for kind, value, raw in Scanner(page).tokens():
        if kind in ("text", "raw"):
            if not in_head:
                piece.append(value if kind == "raw" else html_lib.unescape(value))
                if in_link:
                    nodes[stack[-1]].links += len(value)
        elif kind == "end":
            if value == "head":
                in_head = False
            elif value == "a":
                in_link = max(0, in_link - 1)
            elif value not in INLINE and opened[value]:
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != value:
                    depth -= 1
                close(depth)
        else:
            tag = value
            if tag == "head":
                in_head = True
            elif tag == "body" or tag in CLOSES_P:
                in_head = False
            if tag in RAW:
                piece.append(" ")
            elif tag == "a":
                in_link = 1
            elif tag in INLINE or tag in VOID:
                if tag in ("br", "hr", "img", "wbr", "input"):
                    piece.append("" if tag == "wbr" else " ")
                if tag == "hr":
                    flush()
            elif tag != "head":
                top = nodes[stack[-1]].tag
                if tag in CLOSES_P and top == "p" or tag in HEADINGS and top in HEADINGS:
                    close(len(stack) - 1)
                elif tag in FAMILY and families[-1][FAMILY[tag]] > 0:
                    close(families[-1][FAMILY[tag]])
                add(tag, raw)
                in_link = 0
    flush()
    return nodes, runs


def _bucket(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def node_features(nodes: list[Node]) -> list[list[int]]:
    """Active features of each node."""
    size, links, stops, kids = [n.size for n in nodes], [n.links for n in nodes], [n.stops for n in nodes], [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        size[p] += size[i]
        links[p] += links[i]
        stops[p] += stops[i]
        kids[p] += 1
    out, under = [], [False] * len(nodes)
    for i, n in enumerate(nodes):
        f = [_TAG.get(n.tag, len(TAGS))]
        if i and under[n.parent]:
            f.append(_BASE + 23)
        under[i] = i > 0 and under[n.parent] or n.tag in BAD_TAGS
        if n.raw:
            attrs = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(n.raw)}
            named = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')} {attrs.get('itemprop', '')}").lower())
            bad = any(w in BAD_WORDS for w in named)
            under[i] = under[i] or bad
            f += [_BASE] * bad + [_BASE + 1] * any(w in GOOD_WORDS for w in named)
            if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
                f.append(_BASE + 2)
        f.append(_BASE + 3 + _bucket(size[i], (1, 20, 60, 150, 400)))
        f.append(_BASE + 9 + _bucket(links[i] / size[i] if size[i] else 0, (0.01, 0.3, 0.6)))
        f.append(_BASE + 13 + _bucket(stops[i] / size[i] if size[i] else 0, (0.003, 0.01, 0.03)))
        f.append(_BASE + 17 + _bucket(kids[i], (1, 3, 8)))
        f.append(_BASE + 21 + (n.size > 0))
        out.append(f)
    return out


class TreeModel:
    """Unary weights and two edge tables ``edge[kind][parent state][child state]``."""

    def __init__(self) -> None:
        self.w = np.zeros(FEATURES)
        self.edge = np.zeros((2, 2, 2))

    def marginals(self, nodes: list[Node], feats: list[list[int]], joint: bool = False):
        """P(content) of each node; with ``joint`` also each edge's 2 x 2 marginal, by sum-product."""
        w, n = self.w.tolist(), len(nodes)
        e = np.exp(self.edge).tolist()
        kind = [0 if nodes[v.parent].tag in WRAPPERS else 1 for v in nodes]
        belief = []
        for f in feats:
            x = 0.0
            for k in f:
                x += w[k]
            x = math.exp(max(-30.0, min(30.0, x)))
            belief.append([1 / (1 + x), x / (1 + x)])
        up = [None] * n
        for i in range(n - 1, 0, -1):  # children stand after their parents
            (a, b), t, p = belief[i], e[kind[i]], nodes[i].parent
            m0, m1 = t[0][0] * a + t[0][1] * b, t[1][0] * a + t[1][1] * b
            s = m0 + m1
            up[i] = (m0 / s, m1 / s)
            q = belief[p]
            q0, q1 = q[0] * up[i][0], q[1] * up[i][1]
            s = q0 + q1
            q[0], q[1] = q0 / s, q1 / s
        edges = [None] * n
        for i in range(1, n):
            q, u, t, (a, b) = belief[nodes[i].parent], up[i], e[kind[i]], belief[i]
            r0, r1 = q[0] / u[0], q[1] / u[1]
            j00, j01, j10, j11 = r0 * t[0][0] * a, r0 * t[0][1] * b, r1 * t[1][0] * a, r1 * t[1][1] * b
            s = j00 + j01 + j10 + j11
            belief[i][:] = [(j00 + j10) / s, (j01 + j11) / s]
            if joint:
                edges[i] = (kind[i], j00 / s, j01 / s, j10 / s, j11 / s)
        p = [x[1] for x in belief]
        return (p, edges) if joint else p

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, runs = parse(page)
        p = self.marginals(nodes, node_features(nodes))
        return "\n".join(t for i, t in runs if p[i] >= 0.5)


def labelled_pages(n: int = 160, seed: int = 11) -> list[str]:
    """Pages written from templates; block elements of the article carry ``data-content``."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrstdmk") for _ in range(rng.randint(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: f"{say(3, 14)}{rng.choice(['', ','])} {say(2, 8)}."
    prose = lambda: " ".join(sentence() for _ in range(rng.randint(1, 6)))
    link = lambda: f'<a href="/{word()}">{say(1, 3)}</a>'
    menu = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
    C = 'data-content="1"'
    pages = []
    for _ in range(n):
        para = lambda: rng.choice([prose, sentence, lambda: say(1, 6), lambda: f"{sentence()} {link()} {prose()}"])()
        marks = rng.random() < 0.15
        inner = [f"<h1 {C}>{say(1, 9)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 1, 2, 3, 5, 9))):
            text = re.sub(r" ", lambda _: rng.choice(["### ", "&amp;&amp; ", "$$$ ", " | "]), para()) if marks else para()
            kind = rng.random()
            if kind < 0.75:
                inner.append(f"<p {C}>{text}</p>")
            elif kind < 0.82:
                inner.append(f"<h2 {C}>{say(1, 6)}</h2>")
            elif kind < 0.88:
                inner.append(f"<ul {C}>" + "".join(f"<li {C}>{say(2, 12)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                inner.append(f"<blockquote {C}><p {C}>{prose()}</p></blockquote>")
            elif kind < 0.95:
                inner.append(f"<table {C}><tr {C}><td {C}>{say(1, 4)}</td><td {C}>{say(1, 4)}</td></tr></table>")
            else:
                inner.append(f"<pre {C}>{say(4, 20)}</pre>")
        if rng.random() < 0.4:  # boilerplate inside the article
            odd = [
                f'<div class="{rng.choice(["ad", "promo", "share social", "related", "newsletter"])}">{rng.choice([f"<p>{prose()}</p>", sentence(), menu(3)])}</div>',
                f'<form action="/s"><p>{say(1, 6)}</p><label>{say(1, 2)}</label><input name="q"></form>',
                f"<aside><h3>{say(1, 3)}</h3><p>{prose()}</p></aside>",
                f"<nav>{menu(3)}</nav>",
                f"<footer><p>{sentence()}</p></footer>",
                f'<section class="comments"><div class="comment"><p>{prose()}</p></div></section>',
            ]
            for x in rng.sample(odd, rng.randint(1, 2)):
                inner.insert(rng.randint(1, len(inner)) if inner else 0, x)
        body = "".join(inner)
        body = rng.choice(
            [
                f"<article {C}>{body}</article>",
                f"<article {C}>{body}</article>",
                f"<main {C}><article {C}>{body}</article></main>",
                f"<main {C}>{body}</main>",
                f'<div class="{rng.choice(["content", "post entry", "article-body", "story"])}" {C}>{body}</div>',
                f'<div id="{rng.choice(["content", "main", "post"])}" {C}><section {C}>{body}</section></div>',
                f"<div {C}>{body}</div>",
                body,
            ]
        )
        before = [
            f"<nav>{menu(rng.randint(2, 9))}</nav>",
            f'<header><div class="logo">{say(1, 3)}</div>{menu(4)}</header>',
            f'<header class="site-header"><p>{sentence()}</p></header>',
            f'<div class="{rng.choice(["menu", "navbar", "topbar"])}">{menu(5)}</div>',
            f'<div class="{rng.choice(["ad", "ads banner", "advert", "sponsored"])}">{sentence()}</div>',
            f'<div class="{rng.choice(["cookie-notice", "consent", "notice warning"])}"><p>{prose()}</p></div>',
            f'<form action="/s"><p>{say(1, 4)}</p><input name="q"></form>',
            f'<aside class="sidebar"><h3>{say(1, 3)}</h3>{menu(4)}</aside>',
            f"<div>{menu(4)}</div>",
        ]
        after = [
            f"<footer>&copy; {say(1, 3)} &middot; {sentence()}</footer>",
            f"<footer><p>{sentence()}</p>{menu(3)}</footer>",
            f'<div class="footer">{say(2, 6)} {link()}</div>',
            f"<aside><h3>{say(1, 3)}</h3><p>{prose()}</p></aside>",
            f'<div class="sidebar"><p>{prose()}</p>{menu(3)}</div>',
            f'<section class="comments" id="comments"><h2>{say(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
            '<ol class="comment-list">' + "".join(f"<li><p>{prose()}</p></li>" for _ in range(2)) + "</ol>",
            f'<div class="related"><h3>{say(1, 3)}</h3>{menu(4)}</div>',
            f'<form class="newsletter"><p>{sentence()}</p><input></form>',
            f'<div class="ad">{sentence()}</div>',
            f'<p class="disclaimer copyright">{sentence()}</p>',
        ]
        top = "".join(rng.sample(before, rng.randint(0, 4)))
        pages.append(f"<html><head><title>{say(2, 6)}</title></head><body>{top}{body}{''.join(rng.sample(after, rng.randint(0, 4)))}</body></html>")
    for _ in range(n // 4):  # one block is the whole article
        text = " ".join(sentence() for _ in range(rng.randint(1, 3)))
        block = rng.choice([f"<p {C}>{text}</p>", f"<div {C}>{text}</div>", f"<table {C}><tr {C}><td {C}>{text}</td></tr></table>"])
        block = rng.choice(["{}", f"<div {C}>{{}}</div>", f"<section {C}>{{}}</section>", f'<div class="post" {C}>{{}}</div>']).format(block)
        around = rng.choice([("", ""), (f"<nav>{menu(4)}</nav>", f"<footer><p>{sentence()}</p></footer>"), (f"<div>{menu(4)}</div>", f'<div class="footer">{say(2, 6)} {link()}</div>')])
        pages.append(f"<html><head><title>{say(2, 6)}</title></head><body>{around[0]}{block}{around[1]}</body></html>")
    return pages


def train(pages: list[str], *, rounds: int = 40, rate: float = 2.0, l2: float = 0.002) -> TreeModel:
    """Gradient ascent on the mean exact log-likelihood of the labels, with momentum."""
    data = []
    for page in pages:
        nodes, _ = parse(page)
        data.append((nodes, node_features(nodes), [int("data-content" in v.raw) for v in nodes]))
    model, total = TreeModel(), sum(len(d[0]) for d in data)
    vw, ve = np.zeros_like(model.w), np.zeros_like(model.edge)
    seen_w, seen_e = np.zeros_like(model.w), np.zeros_like(model.edge)
    for nodes, feats, y in data:
        for i, f in enumerate(feats):
            seen_w[f] += y[i]
        for i in range(1, len(nodes)):
            seen_e[0 if nodes[nodes[i].parent].tag in WRAPPERS else 1, y[nodes[i].parent], y[i]] += 1
    for _ in range(rounds):
        gw, ge = seen_w.copy(), seen_e.copy()
        for nodes, feats, _ in data:
            p, edges = model.marginals(nodes, feats, joint=True)
            for f, x in zip(feats, p, strict=True):
                for k in f:
                    gw[k] -= x
            for e in edges[1:]:
                ge[e[0]] -= np.array(e[1:]).reshape(2, 2)
        vw = 0.8 * vw + rate * (gw / total - l2 * model.w)
        ve = 0.8 * ve + rate * (ge / total - l2 * model.edge)
        model.w += vw
        model.edge += ve
    return model


@cache
def default_model() -> TreeModel:
    return train(labelled_pages())


def extract_pages(pages: DataFrame, model: TreeModel | None = None, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``: the main text of the whole html."""
    pages = small_batches(pages)
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("string")
    def extract(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in column:
            yield pd.Series([sent.value.extract(x) for x in s], dtype=object)

    return pages.withColumn(out_col, extract(F.col(html_col)))
