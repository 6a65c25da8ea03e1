import html as html_lib
import random
import time
from html.parser import HTMLParser

import pytest

from axonframe.llm import html_extract as h


def test_held_out_labelled_pages():
    model, right, total = h.default_model(), 0, 0
    for page in h.labelled_pages(60, seed=99):
        nodes, runs = h.parse(page)
        p = model.marginals(nodes, h.node_features(nodes))
        for i, _ in runs:
            right += (p[i] >= 0.5) == ("data-content" in nodes[i].raw)
            total += 1
    assert right / total > 0.95


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    model = h.default_model()
    nodes, _ = h.parse("<body><nav><a href=x>m</a></nav><article><h1>Title here</h1><p>Some text, with words.</p></article></body>")
    feats = h.node_features(nodes)
    u = [sum(model.w[k] for k in f) for f in feats]
    kind = [0 if nodes[v.parent].tag in h.WRAPPERS else 1 for v in nodes]
    total, on = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        e = sum(u[i] for i in range(len(nodes)) if y[i]) + sum(model.edge[kind[i], y[nodes[i].parent], y[i]] for i in range(1, len(nodes)))
        total += np.exp(e)
        on += np.exp(e) * np.array(y)
    assert np.allclose(on / total, model.marginals(nodes, feats), atol=1e-9)


def test_extract(spark):
    page = (
        "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav>"
        "<!-- ad --><div class='ad'>Buy now cheap things here.</div><article><h1>A&amp;B  title</h1><p><b>First&nbsp;part\n of it.<br><p>Second part, longer &lt;tag&gt; and more words.</p><form><p>Sign up for news</p><input></form></article>"
        "<div class='comments'><p>I disagree with all of this, said a reader.</p></div><footer>&copy; someone</footer>"
    )
    rows = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (3, "v", "", None), (4, "w", "<" * 50 + "p" + "<div>" * 5000, None)], "page_id long, url string, html string, text string")
    got = h.extract_pages(rows).collect()
    want = "A&B title\nFirst part of it.\nSecond part, longer <tag> and more words."
    assert [r["text"] for r in got[:4]] == [want, want, "", ""]
    assert h.extract_pages(rows.limit(0)).count() == 0


class Plain(HTMLParser):
    """Text runs of well-formed pages: every block's start and end breaks, with the path of open blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.path, self.runs, self.piece = [], [], []

    def flush(self):
        if text := " ".join(html_lib.unescape("".join(self.piece)).split()):
            self.runs.append((tuple(self.path), text))
        self.piece = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.piece.append(" ")
        elif tag not in h.INLINE:
            self.flush()
            self.path.append(tag)

    def handle_endtag(self, tag):
        if tag not in h.INLINE:
            self.flush()
            self.path.pop()

    def handle_data(self, data):
        self.piece.append(data)

    def handle_entityref(self, name):
        self.piece.append(f"&{name};")

    def handle_charref(self, name):
        self.piece.append(f"&#{name};")


def test_parser_equals_a_plain_one_on_well_formed_pages():
    rng = random.Random(0)
    words = ["one", "two &amp; three", "&lt;b&gt;", "caf\u00e9", "&#8212;", "&#x41;", "a  b\n c", "x > y", "'q'"]

    def body(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4 or depth > 6:
                out.append(rng.choice(words))
            elif kind < 0.55:
                out.append(f"<{(t := rng.choice(['b', 'i', 'span', 'a', 'math', 'object']))} title=\"a > b\">{rng.choice(words)}</{t}>")
            elif kind < 0.62:
                out.append(rng.choice(["<br>", "<!-- c > d -->", "<br/>"]))
            else:
                t = rng.choice(["div", "section", "article", "blockquote"])
                out.append(f"<{t} class='k{depth}'>{body(depth + 1)}</{t}>")
        return " ".join(out)

    for _ in range(300):
        page = f"<html><body><div>{body(0)}</div></body></html>"
        plain = Plain()
        plain.feed(page)
        plain.close()
        nodes, runs = h.parse(page)

        def path(i, nodes=nodes):
            out = []
            while i > 0:
                out.append(nodes[i].tag)
                i = nodes[i].parent
            return tuple(reversed(out))

        assert [(path(i), t) for i, t in runs] == plain.runs, page


@pytest.mark.parametrize(
    "page",
    [
        "<p " * 350_000,
        "<p " * 350_000 + ">",
        "<!x" * 350_000,
        '<p "' * 250_000 + ">",
        "<div>" * 70_000 + "</section>" * 70_000,
        "<dl><dd><dl>" + "<div>" * 50_000 + "<dd></dd>" * 50_000,
        "<script></script " * 60_000,
        "<a '\"><b\">" * 90_000 + "'",
        "<!--" * 250_000,
        "<" * 300_000 + "p",
        "<li><ul>" * 50_000,
    ],
)
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    h.parse(page)
    assert time.perf_counter() - began < 4


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>Hello <script src=x />world</p>", ["Hello world"]),
        ("<p>a <math><mi>x</mi>=<mn>2</mn></math> b</p><xmp>1 <b> 2</xmp>", ["a x=2 b", "1 <b> 2"]),
        ("<p>a<!-->b</p><p>c<noscript>no</noscript>", ["ab", "c"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>x", ["1", "2", "3", "x"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("a < b and <3 <", ["a < b and <3 <"]),
    ],
)
def test_odd_markup(page, texts):
    assert [t for _, t in h.parse(page)[1]] == texts


def test_clashing_columns_and_long_flat_pages(spark):
    flat = "<article>" + "".join(f"<p>Paragraph {i}, with some words in it.</p>" for i in range(4000)) + "</article>"
    rows = spark.createDataFrame([(1, flat, "old")], "page_id long, html string, text string")
    out = h.extract_pages(rows)
    assert out.columns == ["page_id", "html", "text"]
    assert out.collect()[0]["text"].count("\n") == 3999


def _kinds(page):
    return [(k, v) for k, v, _ in h.Scanner(page).tokens()]


def test_quotes_open_strings_in_values_alone():
    page = "<article><p it's>A</p><p>B</p><p a=b'c x=\"1>2\" y = '>'>It isn't lost. C</p></article>"
    assert [v for k, v in _kinds(page) if k == "text"] == ["A", "B", "It isn't lost. C"]
    body = "".join(f"<p>Paragraph {i} of the long article isn't short, and it goes on with several words more.</p>" for i in range(4))
    plain, stray = (h.default_model().extract(f"<html><body><article><p{x}>The first one tells what this page is about in a whole sentence.</p>{body}</article></body></html>") for x in ("", " it's"))
    assert stray == plain and plain


def test_raw_elements_are_not_self_closed():
    for tag in ("script", "style", "textarea"):
        assert [v for k, v in _kinds(f"<{tag} src=http://x.com/a/>var leak = 1;</{tag}>kept") if k == "text"] == ["kept"]
        assert [v for k, v in _kinds(f"<{tag} />var leak = 1;</{tag}>kept") if k == "text"] == ["kept"]


def test_nested_svg_has_no_text():
    assert [v for k, v in _kinds("a<svg><svg x='1'><text>in</text></svg><text>in</text></svg>b") if k == "text"] == ["a", "b"]
    assert [v for k, v in _kinds("a<svg/>b<svg class=\"x\" />c<svg><svg/><g>in</g></svg>d<svg class=x/>in</svg>e") if k == "text"] == ["a", "b", "c", "d", "e"]
