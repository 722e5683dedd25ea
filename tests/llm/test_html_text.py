"""Main text extraction on whole pages, on hand-written pages and on broken input."""

from __future__ import annotations

import html
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloupe.llm.common import table
from sparkloupe.llm.html_text import _order, content, extract_text, main_text, measure, parse


def article_text(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    body = re.sub(r"</?(p|h1)[^<>]*>", "\n", re.sub(r"</?b>", "", re.sub("<br>", " ", body)))
    return "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in body.split("\n")) if x)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table(spark, sf, size):
    pages = table(spark, sf.replace("0.001", size), "pages")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article_text(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_boilerplate_goes():
    page = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use <b>cookies</b></div>
    <nav><a href=x>Home</a></nav><main><article><header><h1>Big &amp; bold</h1></header><p>First   para <a href=q>link</a>.
    <p>Second&nbsp;para<br>line<ul><li>one<li>two</ul><form>Sign <input> up</form><aside>see also</aside></article>
    <section id="comments"><div class="comment">nice!</div></section></main><div class=sidebar><ul><li>side</ul></div><footer>foot</footer>"""
    assert main_text(page) == "Big & bold\nFirst para link.\nSecond para line\none\ntwo"


def test_density_without_article():
    menu = "".join(f'<div><a href="{k}">item {k}</a></div>' for k in range(20))
    story = "".join(f"<p>{'some words of a story ' * 10}</p>" for _ in range(5))
    page = f"<body><div>{menu}</div><div><h2>Head</h2>{story}</div></body>"
    assert main_text(page) == "\n".join(["Head", *[" ".join(["some words of a story"] * 10)] * 5])


def test_wrappers_of_the_article_stay():
    """A form or a class name around the whole article does not cut it; boilerplate in and beside it goes."""
    line = " ".join(["some words of a story"] * 10)
    story = "".join(f"<p>{line}</p>" for _ in range(5))
    side = '<div class="sidebar"><ul><li>side</ul></div>'
    want = "\n".join([line] * 5)
    for name in ("content has-sidebar", "no-sidebar", "toc-enabled", "search-results"):
        assert main_text(f'<body><nav><a href=x>Home</a></nav><div class="{name}">{story}{side}</div><footer>foot</footer></body>') == want
    assert main_text(f'<body><form action=x><div class="has-sidebar"><div id=b>{story}</div>{side}</div><input></form></body>') == want
    assert main_text(f'<body><div>{story}</div><div id="comments">{story * 4}</div></body>') == want
    assert main_text(f'<body><article>{story}</article><div class="related">{story * 4}</div></body>') == want


def test_odd_pages(spark):
    for page in (None, "", "   ", "<", "<p", "<!--", "<script>x", "<div></div>", "</p></div>", "<p class='a>b", "&#xZZ; &", "<nav>only menu</nav>"):
        assert isinstance(main_text(page), str)
    assert main_text("<nav>only menu</nav>") == "" and main_text("plain &lt;text") == "plain <text"
    assert main_text('<p>a<script>var x="</p>"</script> b<!-- c --> d') == "a b d"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert main_text(deep) == "x"
    df = spark.createDataFrame([(1, None, None, "t"), (1, "u", "<p>hi", None)], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in extract_text(df).collect()) == [("", 0), ("hi", 2)]
    assert extract_text(df.limit(0)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<nav>", "</nav>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "<a href='x'>", "</a>", "<br>", "text ", "&amp;", "<!-- x -->", "<article>", "</article>", "<script>", "</script>", "<", ">", '"']), max_size=40))
def test_never_fails(parts):
    text = main_text("".join(parts))
    assert "\n\n" not in text and text == text.strip()


def test_article_names_that_only_look_like_boilerplate():
    line = " ".join(["words of an article"] * 12)
    page = f"<body><nav><a href=x>Home</a></nav><article><p>{line}</p>" + "".join(f'<section class="{c}"><p>{c} {line}</p></section>' for c in ("side-effects", "legal-background", "top-ten", "social-history", "search-theory")) + f'<div class="ad">buy</div><div class="share-buttons">share</div></article></body>'
    text = main_text(page)
    assert all(f"{c} {line}" in text for c in ("side-effects", "legal-background", "top-ten", "social-history", "search-theory")) and "buy" not in text and "share" not in text


def plain(tree, share):
    """Counts and densities of a tree of (tag, children), straight from the formula."""
    tag, children = tree
    chars = sum(len("".join(x.split())) for x in children if isinstance(x, str))
    tags = links = link_tags = 0
    under, total = [], 0.0
    for x in children:
        if not isinstance(x, str):
            part = plain(x, share)
            chars, tags, links, link_tags = chars + part[0]["c"], tags + part[0]["t"] + 1, links + part[0]["lc"], link_tags + part[0]["lt"] + (x[0] == "a")
            total += part[0]["d"]
            under += part
    links = chars if tag == "a" else links
    density = 0.0
    if chars:
        base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
        density = chars / max(1, tags) * (math.log(chars / max(1, links) * max(1, tags) / max(1, link_tags), base) if base > 1 else 1)
    return [{"c": chars, "t": tags, "lc": links, "lt": link_tags, "d": density, "sum": total}, *under]


def written(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>" + "".join(map(written, tree[1])) + f"</{tree[0]}>"


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return ("a" if rng.random() < 0.3 else "span", [" ".join(rng.choice(("word", "of", "text")) for _ in range(rng.randint(1, 30)))])
    return ("div", [grown(rng, depth - 1) for _ in range(rng.randint(1, 4))])


def test_densities_against_the_formula():
    """Every node's density and sum on pages without an article, and the core is the node with the largest sum."""
    rng = random.Random(12)
    for _ in range(150):
        tree = ("body", [grown(rng, rng.randint(1, 5)) for _ in range(rng.randint(1, 4))])
        count = plain(tree, 0.0)[0]
        want = plain(tree, count["lc"] / count["c"])
        root = parse(written(tree))
        nodes = [x for x in measure(root) if x is not root]
        assert [(x.chars, x.tags, x.link_chars, x.link_tags) for x in nodes] == [(w["c"], w["t"], w["lc"], w["lt"]) for w in want]
        assert [x.density for x in nodes] == pytest.approx([w["d"] for w in want]) and [x.total for x in nodes] == pytest.approx([w["sum"] for w in want])
        most = max(w["sum"] for w in want)
        if most > 0:
            again = parse(written(tree))
            todo, inside = content(again), set()
            while todo:
                node = todo.pop()
                inside.add(id(node))
                todo += [x for x in node.items if not isinstance(x, str)]
            assert any(id(x) in inside for x, w in zip(_order(again)[1:], want, strict=True) if w["sum"] >= most * (1 - 1e-9))  # the core is kept
