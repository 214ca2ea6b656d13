"""A page as a flat outline: its texts in order, and for every element the range of texts that it covers.

An element is a number; its descendants are the numbers up to ``stop``, its texts the places from ``first`` to ``last``.
Leaving a part of the page out marks a range, asking what lies inside of an element compares two numbers: nothing is
moved and no tree is walked. Escaped rich text is read as the markup that it spells, forms do not count as elements.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser
from itertools import islice

from .html import BLOCKS, CLOSES, VOID, clean

TEXT, EDGE, QUIET = 0, 1, 2  # kinds of places: text, the edge of a block, text that only labels read
_QUIET = {"script", "style", "noscript", "svg", "button"}
_ESCAPED = re.compile(r"<\s*(ol|ul|li|p|div|br|strong|b|span|table)\b", re.I)


class Outline(HTMLParser):
    def __init__(self, markup: str | None):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.kinds = bytearray()
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.up: list[int] = []
        self.kids: list[list[int]] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.stop: list[int] = []
        self._open: list[int] = []
        self._quiet = self._nested = 0
        self._begin("", {})
        self.feed(markup or "")
        self.close()
        while self._open:
            self._end()
        self.gone = bytearray(len(self.tags))  # elements left out
        self.cut = bytearray(len(self.texts))  # texts left out

    # --- reading ---------------------------------------------------------------------------------------------------
    def _place(self, text: str, kind: int) -> None:
        self.texts.append(text)
        self.kinds.append(kind)

    def _begin(self, tag: str, attrs: dict[str, str]) -> None:
        n = len(self.tags)
        up = self._open[-1] if self._open else -1
        if up >= 0:
            self.kids[up].append(n)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.up.append(up)
        self.kids.append([])
        self.first.append(len(self.texts))
        self.last.append(0)
        self.stop.append(0)
        self._open.append(n)
        self._quiet += tag in _QUIET
        if tag in BLOCKS:
            self._place("\n- " if tag == "li" else "\n", EDGE)

    def _end(self) -> None:
        n = self._open.pop()
        if self.tags[n] in BLOCKS:
            self._place("\n", EDGE)
        self._quiet -= self.tags[n] in _QUIET
        self.last[n], self.stop[n] = len(self.texts), len(self.tags)

    def handle_starttag(self, tag, attrs):
        if tag == "form":
            return
        if self.tags[self._open[-1]] in CLOSES.get(tag, ()) and len(self._open) > 1:
            self._end()
        self._begin(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self._end()

    def handle_startendtag(self, tag, attrs):
        if tag != "form":
            self._begin(tag, {k: v or "" for k, v in attrs})
            self._end()

    def handle_endtag(self, tag):
        depth = next((d for d in range(len(self._open) - 1, 0, -1) if self.tags[self._open[d]] == tag), 0)
        while depth and len(self._open) > depth:
            self._end()

    def handle_data(self, data):
        if self._nested < 3 and not self._quiet and _ESCAPED.search(data):
            inner, depth = _Nested(self), len(self._open)
            self._nested += 1
            inner.feed(data)
            inner.close()
            self._nested -= 1
            while len(self._open) > depth:
                self._end()
            return
        self._place(data, QUIET if self._quiet else TEXT)

    # --- asking ----------------------------------------------------------------------------------------------------
    def within(self, n: int):
        """Elements inside of ``n`` that are not left out, in order."""
        return (k for k in range(n + 1, self.stop[n]) if not self.gone[k])

    def has(self, n: int, tags: set[str]) -> bool:
        return any(self.tags[k] in tags for k in self.within(n))

    def leaf(self, n: int) -> bool:
        return next(self.within(n), None) is None

    def css(self, n: int) -> str:
        return self.attrs[n].get("class", "")

    def find(self, n: int, name: str) -> int | None:
        """The first element inside of ``n`` with that id."""
        return next((k for k in self.within(n) if self.attrs[k].get("id") == name), None)

    def above(self, n: int):
        while (n := self.up[n]) >= 0:
            yield n

    def leads(self, n: int) -> bool:
        """Whether ``n`` is the first thing in the element above it, blank text aside."""
        up = self.up[n]
        before = any(not self.gone[k] for k in self.kids[up][: bisect_left(self.kids[up], n)])
        return not before and not self._said(self.first[up], self.first[n])

    def followed(self, n: int) -> bool:
        """Whether another element comes after ``n`` in the element above it."""
        kids = self.kids[self.up[n]]
        return any(not self.gone[k] for k in kids[bisect_left(kids, n) + 1 :])

    def _said(self, a: int, b: int) -> bool:
        return any(not self.cut[k] and self.kinds[k] != EDGE and self.texts[k].strip() for k in range(a, b))

    def label(self, n: int, glue: str = " ") -> str:
        """All texts of an element, trimmed and put together."""
        return glue.join(t for k in range(self.first[n], self.last[n]) if not self.cut[k] and self.kinds[k] != EDGE and (t := self.texts[k].strip()))

    def body(self, a: int, b: int, around: int | None = None) -> str:
        """Lines of the places from ``a`` to ``b``; with ``around``, its direct parts have lines of their own."""
        edges = {p for k in self._meeting(around, a, b) for p in (self.first[k], self.last[k])} if around is not None else ()
        return clean("".join("\n" * (k in edges) + ("" if self.cut[k] or self.kinds[k] == QUIET else self.texts[k]) for k in range(a, b))) or ""

    def _meeting(self, n: int, a: int, b: int):
        """Direct parts of ``n`` that meet the places from ``a`` to ``b``."""
        for k in islice(self.kids[n], bisect_left(self.kids[n], a, key=self.last.__getitem__), None):
            if self.first[k] > b:
                return
            yield k

    def block(self, n: int) -> str:
        return self.body(self.first[n], self.last[n])

    # --- leaving out -----------------------------------------------------------------------------------------------
    def leave_out(self, n: int) -> None:
        self.gone[n : self.stop[n]] = b"\1" * (self.stop[n] - n)
        self.cut[self.first[n] : self.last[n]] = b"\1" * (self.last[n] - self.first[n])

    def end_at(self, n: int, whole: int) -> None:
        """Leave out ``n`` and all that begins after it inside of ``whole``."""
        self.gone[n : self.stop[whole]] = b"\1" * (self.stop[whole] - n)
        self.cut[self.first[n] : self.last[whole]] = b"\1" * (self.last[whole] - self.first[n])


class _Nested(HTMLParser):
    """Markup inside of a text, read into the outline that met it."""

    def __init__(self, into: Outline):
        super().__init__(convert_charrefs=True)
        self.handle_starttag, self.handle_startendtag = into.handle_starttag, into.handle_startendtag
        self.handle_endtag, self.handle_data = into.handle_endtag, into.handle_data
