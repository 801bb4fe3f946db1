"""Title and visible text of HTML pages, as an Arrow-batched function."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose text is never visible content, and elements without an end tag.
HIDDEN = {"script", "style", "nav", "header", "footer", "aside", "noscript", "svg", "iframe", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Places of the main text, in the order in which they are tried.
MAIN = [("tag", "article"), ("tag", "main"), ("role", "main"), ("class", "content"), ("id", "content")]
LEAST_BYTES = 100


class _Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _walk(node):
    """Elements in document order."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, _Element))


def _texts(node, skip: set):
    stack = list(reversed(node.children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            yield n
        elif n.tag not in skip:
            stack.extend(reversed(n.children))


def _visible(node) -> str:
    return " ".join(t for t in (x.strip() for x in _texts(node, HIDDEN)) if t)


def parse(html: str | None) -> tuple[str, str]:
    """(title, text): the title or first heading; the main text if a main element has enough, else the body's."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = list(_walk(tree.root))
    title = ""
    for tag in ("title", "h1"):
        first = next((n for n in nodes if n.tag == tag), None)
        title = title or ("".join(_texts(first, set())).strip() if first else "")
    for kind, value in MAIN:
        hits = [n for n in nodes if (n.tag == value if kind == "tag" else value in n.attrs.get("class", "").split() if kind == "class" else n.attrs.get(kind) == value)]
        text = "\n\n".join(map(_visible, hits))
        if len(text.encode()) > LEAST_BYTES:
            break
    else:
        body = next((n for n in nodes if n.tag == "body"), tree.root)
        text = _visible(body)
    return title, " ".join(text.split())


def _parse_all(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(h) for h in html], columns=["title", "text"])


def parse_html(html: str) -> Column:
    """A struct of title and text from a column of pages."""
    return F.pandas_udf(_parse_all, "title string, text string")(F.col(html))


#: The references that a title's markup is decoded by, each whole with its semicolon, & last.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def title_markup(html: Column) -> Column:
    """What stands in the first title element, trimmed of spaces; empty without one, null without a page.

    Only REFERENCES are decoded: `&amp` without a semicolon, as where a title was cut, stays as it is (parse decodes it
    as browsers do, and takes the first heading where there is no title).
    """
    title = F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1)
    for written, meant in REFERENCES.items():
        title = F.replace(title, F.lit(written), F.lit(meant))
    return F.regexp_replace(title, r"^\p{Zs}+|\p{Zs}+\z", "")
