"""HTML extraction on the standard library's parser (S03, F11, F50-F52, F43); the only scalar Python functions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkstream.functions.selectors import DROPPED, VOID, Automaton, Element, Page, whole_references

# Where the text, the author and the date of a page are looked for, in this order.
CONTENT = ["article", "[role=main]", "main", ".article-body", ".post-content", ".entry-content", ".content", "body"]
AUTHOR = ["[rel=author]", ".author", "[itemprop=author]", "meta[name=author]"]
DATE = ["time[datetime]", "[itemprop=datePublished]", "meta[property=article:published_time]", "meta[name=publish-date]"]


class Node:
    """An element with attributes and children (elements or strings)."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in DROPPED:
                stack.extend(reversed(node.children))
        return "".join(out)

    def matches(self, simple: str) -> bool:
        """One simple selector: tag, .class, #id, [attr], [attr=value], in any combination."""
        for kind, name, _, value in re.findall(r"([.#\[]|^)([\w-]+)(=([^\]]*))?\]?", simple):
            value = value.strip("\"'")
            if kind == "" and self.tag != name:
                return False
            if kind == "." and name not in self.attrs.get("class", "").split():
                return False
            if kind == "#" and self.attrs.get("id") != name:
                return False
            if kind == "[" and (name not in self.attrs or (value and self.attrs[name] != value)):
                return False
        return True

    def select(self, selector: str) -> Iterator[Node]:
        """Elements below this one that match a list of selectors with descendant combinators."""
        ways = [s.split() for s in selector.split(",") if s.strip()]
        for node in self.walk():
            if node is not self and any(node._fits(way, self) for way in ways):
                yield node

    def _fits(self, way: list[str], top: Node) -> bool:
        if not self.matches(way[-1]):
            return False
        node, rest = self.parent, way[:-1]
        while rest and node is not None and node is not top:
            if node.matches(rest[-1]):
                rest = rest[:-1]
            node = node.parent
        return not rest

    def first(self, selector: str) -> Node | None:
        return next(self.select(selector), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(whole_references(html or ""))
    builder.close()
    return builder.root


_ARTICLE = Automaton([*CONTENT, *AUTHOR, *DATE, "title", "h1", "body"])
_TITLE = len(CONTENT) + len(AUTHOR) + len(DATE)


def article(html: str) -> tuple[str, str, str | None, str | None]:
    """text, title, author and date of a page."""
    page = Page.of(html, _ARTICLE, frozenset([_TITLE]))
    first, content = page.top.first, ""
    for k in range(len(CONTENT)):
        if (e := first(k)) is not None:
            content = e.text()
            if len(content) > 500:
                break
    if len(content) < 500:
        body = first(_TITLE + 2)
        content = body.text() if body is not None else "".join(p for p, dropped in page.pieces if not dropped)
    titles = "".join(e.text() for e in page.top.found.get(_TITLE, ())).strip()
    if not titles and (h1 := first(_TITLE + 1)) is not None:
        titles = h1.text().strip()

    def value(selectors: range, *attrs: str, text_first: bool) -> str | None:
        for k in selectors:
            if (e := first(k)) is not None:
                options = [e.attrs.get(a) for a in attrs]
                if found := next((o for o in ([e.text(), *options] if text_first else [*options, e.text()]) if o), None):
                    return found
        return None

    authors = range(len(CONTENT), len(CONTENT) + len(AUTHOR))
    return re.sub(r"\s+", " ", content).strip(), titles, value(authors, "content", text_first=True), value(range(authors.stop, _TITLE), "datetime", "content", text_first=False)


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("text", "title", "author", "date")]))
def extract_article(html: pd.Series) -> pd.DataFrame:
    """F50 over a column of pages."""
    return pd.DataFrame([article(h or "") for h in html], columns=["text", "title", "author", "date"])


_DATES = re.compile(r"\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}|\d+\s+(?:hour|day|week|month)s?\s+ago", re.I)


def date_beside(node: Node, anchor: Node | None) -> str:
    """a date without a selector: the text right after the item, or after its link, else a date among the item's own
    words beside the link's."""
    for at in (node, anchor):
        if at is not None and at.parent is not None:
            row = at.parent.children
            after = row[row.index(at) + 1 :][:1]
            if after and isinstance(after[0], str) and after[0].strip():
                return after[0].strip()
    rest = node.text().replace(anchor.text(), "", 1) if anchor is not None else node.text()
    found = _DATES.search(rest)
    return found.group(0) if found else ""


def _beside(item: Element, anchor: Element | None) -> str:
    """``date_beside`` for elements of one pass."""
    for e in (item, anchor):
        if e is not None and e.after:
            return e.after
    found = _DATES.search(item.text().replace(anchor.text(), "", 1) if anchor is not None else item.text())
    return found.group(0) if found else ""


def listed(html: str, base: str, ways: list[tuple[str, str, str | None, str | None]], beside: bool) -> list[dict]:
    """The items of a page by the first way (item, link, title, date) that finds some; all ways go along in one pass."""
    outer, inner = _compiled(tuple(ways))
    page = Page.of(html, outer, frozenset(range(len(ways))), dict(enumerate(inner)))
    for k in range(len(ways)):
        out = []
        for n, item in enumerate(page.top.found.get(k, ())):
            link, heading, when = (page.scopes[k, n].first(x) for x in range(3))
            anchor = item if item.tag == "a" else link
            href = anchor.attrs.get("href") if anchor is not None else None
            words = (heading.text() if heading is not None else "").strip() or (anchor.text() if anchor is not None else "")
            told = (when.attrs.get("datetime") or when.text()).strip() if when is not None else _beside(item, anchor) or None if beside else None
            out.append({"title": re.sub(r"\s+", " ", words).strip(), "url": urljoin(base, href) if href else None, "date_text": told})
        if out:
            return out
    return []


@lru_cache(maxsize=64)
def _compiled(ways: tuple) -> tuple[Automaton, list[Automaton]]:
    return Automaton(item for item, *_ in ways), [Automaton(rest) for _, *rest in ways]


def items(item: str, link: str, title: str | None = None, date: str | None = None, fallback: tuple[str, str, str | None, str | None] | None = None, beside: bool = False):
    """A function over (html, url) columns that lists a page's items by selectors, or by the fallback set if
    the first finds none. Each has title, absolute url and date text; ``beside`` looks for dates that no selector names."""
    ways = [(item, link, title, date), *([fallback] if fallback else [])]

    @F.pandas_udf("array<struct<title: string, url: string, date_text: string>>")
    def found(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([listed(h or "", u or "", ways, beside) for h, u in zip(html, url, strict=True)])

    return found


@F.pandas_udf(StringType())
def absolute_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """F11."""
    return pd.Series([urljoin(b, h) if b is not None and h is not None else None for b, h in zip(base, href, strict=True)])


def renamed(names: dict[str, str]):
    """a function over JSON texts that renames values and keys at any depth; a second pass changes nothing."""

    def walk(x):
        if isinstance(x, dict):
            return {names.get(k, k): walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return names.get(x, x) if isinstance(x, str) else x

    @F.pandas_udf("string")
    def migrate(raw: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(walk(json.loads(r)), ensure_ascii=False) if r is not None else None for r in raw])

    return migrate


def looks_like_xml(x: Column) -> Column:
    """F52."""
    return F.ltrim(x).rlike(r"(?i)^(<\?xml|<rss|<feed|<rdf)")


def count_items(x: Column) -> Column:
    """RSS items, else Atom entries."""
    n = F.size(F.regexp_extract_all(x, F.lit(r"(<item[\s>])"), 1))
    return F.when(n > 0, n).otherwise(F.size(F.regexp_extract_all(x, F.lit(r"(<entry[\s>])"), 1)))
