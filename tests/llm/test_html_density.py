"""Main-text extraction: densities against brute force, whole tables against the known markup, layouts."""

from __future__ import annotations

import html
import math
import os
import random
import re

import pyarrow.parquet as pq
import pytest

from engram.llm import html_text

P = ["The river ran past the old mill and on to the sea, as it had for years.", "A second paragraph tells of the people who lived there, and what they did all day long.", "The last one is short."]
TEXT = "".join(f"<p>{x}</p>" for x in P)
NAV = "<nav><a href=1>Home</a> <a href=2>About</a> <a href=3>News</a></nav>"


def brute(x, body):
    """(chars, tags, link chars, link tags, density, total) by plain recursion."""
    nodes = [k for k in x.kids if isinstance(k, html_text.Node)]
    below = [brute(k, body) for k in nodes]
    chars = sum(len(html.unescape(k)) for k in x.kids if isinstance(k, str) and k.strip()) + sum(b[0] for b in below)
    tags = sum(1 + b[1] for b in below)
    link_tags = sum(b[3] + (k.tag == "a" or k.noise or k.soft) for k, b in zip(nodes, below))
    links = chars if x.tag == "a" or x.noise or x.soft else sum(b[2] for b in below)
    density = 0.0
    if chars and not x.noise and not x.soft:
        lc, lt, t = max(1, links), max(1, link_tags), max(1, tags)
        gain = chars / lc * t / lt + (links == 0)
        if gain > 1:
            density = chars / t * math.log(gain, math.log(chars / max(1, chars - links) * lc + max(1, body.link_chars) / max(1, body.chars) * chars + math.e))
    return chars, tags, links, link_tags, density, sum(b[4] for b in below)


def test_densities_and_the_chosen_subtree_equal_brute_force():
    rng = random.Random(8)

    def element(depth):
        tag = rng.choice("div p a span section ul nav h2 footer".split())
        word = rng.choice(["", "", " class=related", " id=ad-3"])
        return f"<{tag}{word}>" + "".join(element(depth + 1) if depth < 4 and rng.random() < 0.5 else rng.choice(["word ", "a longer run of text &amp; more ", " "]) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(200):
        body = html_text.parse_dom("".join(element(0) for _ in range(4)))
        order = html_text._tree(body)
        html_text._furniture(order)
        html_text._measure(order)
        for x in order:
            got = x.chars, x.tags, x.link_chars, x.link_tags, x.density, x.total
            assert got == pytest.approx(brute(x, body))
        picked, threshold, _ = html_text._content(order)
        most = max(x.total for x in order)
        if most > 0:
            best = next(x for x in order if x.total == most)  # the first in page order
            up, path = best, [best.density]
            while up.parent is not None:
                up = up.parent
                path.append(up.density)
            assert threshold == min(path)
            assert any(best is x or x in _above(best) for x in picked)


def _above(x):
    out = []
    while x.parent is not None:
        x = x.parent
        out.append(x)
    return out


def article_of(page: str) -> str:
    """The text of the table's pages, whose articles hold only h1, p, b and br."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_every_page_of_the_table_gives_its_article_and_density_decides():
    pages = pq.read_table(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01") + "/pages.parquet").to_pylist()
    pages = [r["html"] for r in pages if r["html"]]
    assert len(pages) > 100
    assert [html_text.main_text(p) for p in pages] == [article_of(p) for p in pages]
    # words about furniture stay on; only the choice by density is off: the adverts of every page stay
    assert not any(html_text.main_text(p, density=False) == article_of(p) for p in pages)
    bare = sum(html_text.main_text(p, hints=False) == article_of(p) for p in pages)
    assert bare >= 0.93 * len(pages)  # the densities alone, no word about furniture


LAYOUTS = {
    "plain divs": (f"<div><ul><li><a href=1>Home</a><li><a href=2>About us</a><li><a href=3>News</a></ul></div><div>{TEXT}</div><div><a href=9>Terms</a> <a href=8>Privacy</a></div>", P),
    "article": (
        f'{NAV}<div class="ad">Buy this fine thing now, only today, at half the price</div><article><h1>Title</h1>{TEXT}<section id=comments><p>What a lovely text, thanks for all of this, I liked it</p>'
        "<p>Me too, and so did all of my friends here</p></section></article><aside><p>See also this long text about another thing entirely</p></aside>"
        "<form><label>Email</label><input><button>Go</button></form><footer>Copyright by the owner, all rights are reserved</footer>",
        ["Title", *P],
    ),
    "main": (
        f"<header><h1>Site</h1><p>tagline of the site</p></header><main><h2>Title</h2>{TEXT}</main><div class=sidebar><p>Sidebar text is here and quite long for a sidebar</p></div>"
        "<div id=cookie-banner>We use cookies to improve your experience here</div>",
        ["Title", *P],
    ),
    "sections": (f"{NAV}<div class=content><h1>Title</h1><section>{TEXT}</section><section>{TEXT}</section></div><div class=footer>Copyright by the owner</div>", ["Title", *P, *P]),
    "many comments": (f"<article><h1>T</h1>{TEXT}</article><div class=comments>{TEXT * 3}</div>", ["T", *P]),
    "short": ("<nav><a href=1>a</a></nav><article><p>Hi.</p></article><footer>A long footer text which goes on and on for a while</footer>", ["Hi."]),
    "table": (f"{NAV}<table><tr><td><a href=1>x</a><a href=2>y</a></td><td><h1>Title</h1>{TEXT}</td></tr></table>", ["Title", *P]),
    "lead": (
        f"<article><h1>T</h1><div>Lead text in a div of its own.</div><div class=body>{TEXT}</div><ul><li>one item<li>two items</ul></article>",
        ["T", "Lead text in a div of its own.", *P, "one item", "two items"],
    ),
    "links": (f"<article>{TEXT}<ul><li><a href=1>Read this also</a><li><a href=2>And this</a><li><a href=3>And more</a></ul><p>See <a href=1>the report of the committee</a></p></article>", [*P, "See the report of the committee"]),
    "class on the wrapper": (f'<div class="page banner">{NAV}<h1>T</h1>{TEXT}</div>', ["T", *P]),
    "one character": ("<p>x", ["x"]),
}


LINES = " ".join(P)
SAID = ["The committee met on Monday and spoke for hours of the bridge, its cost and its age.", "Nobody there knew who had built it, though many had crossed it every day of their lives."]
PROSE = "".join(f"<p>{x}</p>" for x in SAID * 2 + SAID[:1])
MISLED = SAID * 2 + SAID[:1]


@pytest.mark.parametrize("word", ["related", "alert", "ad", "widget promo", "notice"])
@pytest.mark.parametrize("wrap", ["{}", "<div class=body>{}</div>"])
def test_prose_under_a_misleading_class_inside_the_article_stays(word, wrap):
    inside = wrap.format(f'<h1>Title</h1>{TEXT}<div class="{word}">{PROSE}</div>{TEXT}')
    page = f"{NAV}<article>{inside}</article><div class={word.split()[0]}>Buy now, only today</div>"
    assert html_text.main_text(page) == "\n".join(["Title", *P, *MISLED, *P])
    beside = f'<article><div><h1>Title</h1>{TEXT}{TEXT}</div><div class="{word}">{PROSE}</div></article>'
    assert html_text.main_text(f"{NAV}{beside}") == "\n".join(["Title", *P, *P, *MISLED])


@pytest.mark.parametrize("word", ["related", "alert", "ad", "notice", "newsletter"])
def test_short_furniture_inside_the_article_goes(word):
    page = f'{NAV}<article><h1>Title</h1>{TEXT}<div class="{word}">Buy this now.</div><div class="{word}"><a href=1>More of this</a> <a href=2>And that</a></div>{TEXT}</article>'
    assert html_text.main_text(page) == "\n".join(["Title", *P, *P])
    # reader comments and furniture by tag go however dense they are
    for block in (f"<div class=comments>{PROSE}</div>", f"<aside>{PROSE}</aside>", f"<div role=navigation>{PROSE}</div>"):
        assert html_text.main_text(f"<article><h1>Title</h1>{TEXT}{block}</article>") == "\n".join(["Title", *P])


def test_very_long_and_deep_pages():
    long = "<p>" + "word " * 400_000 + "</p>"
    assert len(html_text.main_text(f"{NAV}<article>{long}</article>")) == 5 * 400_000 - 1
    deep = "<div>" * 20_000 + LINES + "</div>" * 20_000
    assert html_text.main_text(deep) == LINES


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    assert html_text.main_text(f"<html><body>{page}</body></html>") == "\n".join(want)
