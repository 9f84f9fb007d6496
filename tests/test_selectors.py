"""One pass by automata against a walk through the parsed tree."""

import random
import re
from urllib.parse import urljoin

import pytest

from inkstream.functions import html
from inkstream.functions.selectors import Automaton, Page


def tree_article(page):
    root, content = html.parse(page), ""
    for selector in html.CONTENT:
        if (node := root.first(selector)) is not None:
            content = node.text()
            if len(content) > 500:
                break
    if len(content) < 500:
        body = root.first("body")
        content = body.text() if body is not None else root.text()
    titles = "".join(n.text() for n in root.select("title")).strip()
    if not titles and (h1 := root.first("h1")) is not None:
        titles = h1.text().strip()

    def value(selectors, attrs, text_first):
        for s in selectors:
            if (node := root.first(s)) is not None:
                options = [node.attrs.get(a) for a in attrs]
                if found := next((o for o in ([node.text(), *options] if text_first else [*options, node.text()]) if o), None):
                    return found
        return None

    return re.sub(r"\s+", " ", content).strip(), titles, value(html.AUTHOR, ["content"], True), value(html.DATE, ["datetime", "content"], False)


def tree_items(page, base, ways, beside):
    root = html.parse(page)
    for item, link, title, date in ways:
        out = []
        for node in root.select(item):
            anchor = node if node.tag == "a" else node.first(link)
            heading, when = node.first(title) if title else None, node.first(date) if date else None
            href = anchor.attrs.get("href") if anchor is not None else None
            words = (heading.text() if heading is not None else "").strip() or (anchor.text() if anchor is not None else "")
            told = (when.attrs.get("datetime") or when.text()).strip() if when is not None else html.date_beside(node, anchor) or None if beside else None
            out.append({"title": re.sub(r"\s+", " ", words).strip(), "url": urljoin(base, href) if href else None, "date_text": told})
        if out:
            return out
    return []


TAGS = ["div", "p", "a", "h1", "h2", "li", "article", "main", "time", "title", "span", "script", "noscript", "br", "img", "body", "meta", "object"]
ATTRS = ['class="content"', 'class="author x"', 'class="teaser"', 'role="main"', 'rel=author', 'href="/l"', 'datetime="2024-01-02"', 'itemprop="datePublished"', 'id="i"', 'name="author"', 'content="c"']


def random_page(rng):
    """Tags that close in order, out of order, twice or never."""
    out, open_ = [], []
    for _ in range(rng.randint(0, 60)):
        kind = rng.random()
        if kind < 0.45:
            tag = rng.choice(TAGS)
            out.append(f"<{tag} {' '.join(rng.sample(ATTRS, rng.randint(0, 3)))}{rng.choice(('', '', '', '/'))}>")
            open_.append(tag)
        elif kind < 0.7 and open_:
            out.append(f"</{open_.pop() if rng.random() < 0.8 else rng.choice(TAGS)}>")
        else:
            out.append(rng.choice(("text ", "3 days ago", " ", "&amp; more", "<!-- no -->", "x" * 200, "12 March 2024 ")))
    return "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_one_pass_equals_the_tree(seed):
    rng = random.Random(seed)
    ways = [(".teaser", "a", "h2", "time"), ("div p, li", "div a", None, "[datetime]"), ("a", "a", "span.content", None)]
    for _ in range(400):
        page = random_page(rng)
        assert html.article(page) == tree_article(page), page
        some = rng.sample(ways, rng.randint(1, 3))
        for beside in (False, True):
            assert html.listed(page, "http://s/b", some, beside) == tree_items(page, "http://s/b", some, beside), (page, some)


@pytest.mark.parametrize("selector", ["div p a", "div div", ".teaser a[href]", "article .content, main #i", "a.author.x", "[role=main] [rel]", "span"])
def test_selectors(selector):
    """All matches, in order."""
    rng = random.Random(selector)
    for _ in range(300):
        page = random_page(rng)
        found = Page.of(page, Automaton([selector]), frozenset([0])).top.found.get(0, [])
        assert [(e.tag, e.attrs, e.text()) for e in found] == [(n.tag, n.attrs, n.text()) for n in html.parse(page).select(selector)], page


def test_given_pages(spark, sf):
    from inkstream.session import table

    for r in table(spark, sf, "pages").collect():
        assert html.article(r["html"]) == tree_article(r["html"])


def test_references_without_a_semicolon_stay():
    page = "<title>a &amp;&amp</title><body><h1>x &lt &amp;lt; &#65 &#65; &copy; &a</h1><a href='/?b=1&copy=2&amp;c'>&lt;</a></body>"
    assert html.article(page)[:2] == ("x &lt &lt; &#65 A © &a<", "a &&amp")
    assert html.parse(page).first("h1").text() == "x &lt &lt; &#65 A © &a" and html.parse(page).first("a").attrs == {"href": "/?b=1&copy=2&c"}
