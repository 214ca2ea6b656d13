"""HTML to text and fields with the standard library's parser: a small tree, and the page parsers built on it."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "ul", "ol", "section", "article", "table", "tr", "td", "th", "dd", "dt", "br", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "main"}
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ZERO = re.compile("[​-‏﻿]")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """All nodes below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def strings(self):
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack.extend(reversed(c.children))

    def text(self, glue: str = " ") -> str:
        return glue.join(t for s in self.strings() if (t := s.strip()))

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES and self.at.tag in CLOSES[tag]:
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent or self.root

    def handle_data(self, data):
        self.at.children.append(data)


def tree(markup: str | None) -> Node:
    b = _Builder()
    b.feed(markup or "")
    b.close()
    return b.root


def clean(text: str | None) -> str | None:
    """Lines with single spaces, trimmed; empty lines dropped; None where nothing is left."""
    t = _ZERO.sub("", text or "").replace(" ", " ")
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in t.splitlines())
    return "\n".join(x for x in lines if x) or None


def drop(root: Node, tags: set[str]) -> None:
    for n in list(root.walk()):
        if n.tag in tags:
            n.remove()


def page_title_and_text(markup: str | None) -> tuple[str | None, str | None]:
    """Title (h1, h2 or title) and text (main, article or body) without navigation, forms and scripts."""
    root = tree(markup)
    drop(root, {"script", "style", "noscript", "nav", "header", "footer", "form", "aside"})
    head = root.first("h1") or root.first("h2") or root.first("title")
    body = root.first("main") or root.first("article") or root.first("body") or root
    return (clean(head.text()) if head else None), clean(body.text("\n"))


def title_and_text(c: Column) -> Column:
    """struct(title, text) of a markup column; Arrow-batched."""

    @F.pandas_udf("struct<title:string,text:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_title_and_text(x) if x is not None else (None, None) for x in s], columns=["title", "text"])

    return run(c)
