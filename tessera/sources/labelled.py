"""Service pages of any theme: what each element is comes from one table, sections are ranges of the page's texts.

Every element gets its roles once, from ``MARKS``. A section is a name and a range of places: that of the panel a tab
points to, that of an element with a known id, or what follows a label. All of them are read by the same reader, and
what a range was taken from is left out for the next ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from .html import clean
from .outline import Outline


@dataclass(frozen=True)
class Mark:
    """A role and what an element must show to have it; parts that are not given hold. Case matters, as it does in pages."""

    role: str
    tags: tuple[str, ...] = ()
    names: tuple[str, ...] = ()  # one of its classes
    parts: tuple[str, ...] = ()  # in the text of its classes
    like: str = ""  # a pattern found in the text of its classes
    ids: tuple[str, ...] = ()
    id_parts: tuple[str, ...] = ()
    attrs: dict[str, tuple[str, ...]] = field(default_factory=dict)  # an attribute and its values, one of them
    style: str = ""  # a pattern found in its style

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        css, own = attrs.get("class", ""), attrs.get("id", "")
        return (
            (not self.tags or tag in self.tags)
            and (not self.names or bool(set(self.names) & set(css.split())))
            and (not self.parts or any(p in css for p in self.parts))
            and (not self.like or re.search(self.like, css) is not None)
            and (not self.ids or own in self.ids)
            and (not self.id_parts or any(p in own for p in self.id_parts))
            and (not self.attrs or any(attrs.get(k) in v for k, v in self.attrs.items()))
            and (not self.style or re.search(self.style, attrs.get("style", "")) is not None)
        )


# --- fixed values: what elements of service pages are, by tag, class, id, attribute and style ------------------------------
MARKS = [
    Mark("frame", tags=("script", "style", "noscript", "svg", "iframe", "nav", "footer")),
    Mark("frame", names=("swiper", "ms-hide")),
    Mark("frame", parts=("related", "rating", "share", "carousel", "carousal", "services_card", "service-card")),
    Mark("frame", id_parts=("related",)),
    Mark("hidden", style="display: ?none"),
    Mark("trail", parts=("breadcrumb",)),
    Mark("tab", attrs={"role": ("tab",), "data-toggle": ("pill", "tab"), "data-bs-toggle": ("pill", "tab")}),
    Mark("anchor", tags=("a",)),
    Mark("tabs", attrs={"role": ("tablist", "tabpanel")}),
    Mark("tabs", names=("tab-pane",)),
    Mark("tabs", tags=("ul",), names=("nav-pills", "nav-tabs")),
    Mark("head", tags=("h2", "h3", "h4", "h5", "h6", "dt")),
    Mark("head", parts=("field__label",)),
    Mark("lead", tags=("strong", "b")),
    Mark("pair", tags=("p", "div", "span"), like=r"fw-bold|font-bold|\blabel\b|-label|title"),
    Mark("list card", like="card|slide|teaser|views-row"),
    Mark("other", tags=("h2", "h3", "h4", "h5", "p", "div", "span")),
]
#: Attributes that marks ask for; elements that are equal in them and in their tag have the same roles.
ASKED = tuple(sorted({"class", "id", "style"} | {k for m in MARKS for k in m.attrs}))


@lru_cache(maxsize=1024)
def _roles(tag: str, given: tuple[str | None, ...]) -> frozenset[str]:
    attrs = {k: v for k, v in zip(ASKED, given, strict=True) if v is not None}
    return frozenset(m.role for m in MARKS if m.fits(tag, attrs))


TAB_POINTERS = ("data-bs-target", "data-target", "aria-controls", "href")
SECTION_IDS = {"steps": "Steps", "terms": "Conditions", "document": "Required Documents"}
DESCRIPTION_CLASS = r"(?i)(^|[-_])(service-)?desc(ription)?([-_]txt|[-_]text)?$"
FILLER_LINES = ("page content", "محتوى الصفحة")


@dataclass
class Rules:
    """Patterns of labels and texts, and the field that a label names."""

    label_field: Callable[[str], str | None]
    stop: str
    related: str
    placeholder: str
    service_level: str
    chrome: str


class Page:
    """An outline with the roles of its elements, from the part that holds the content."""

    def __init__(self, markup: str | None, rules: Rules):
        self.o, self.rules = Outline(markup), rules
        self.roles = [_roles(t, tuple(map(a.get, ASKED))) for t, a in zip(self.o.tags, self.o.attrs, strict=True)]
        self.main = next((n for n in self.o.within(0) if self.o.tags[n] in ("main", "article")), 0)
        first = next(self.having("h1"), None)
        self.title = clean(self.o.label(first)) if first is not None else None  # read first: some frames hold it
        self._leave_frame()

    def having(self, *tags: str) -> Iterator[int]:
        return (n for n in self.o.within(self.main) if self.o.tags[n] in tags)

    def being(self, *roles: str) -> Iterator[int]:
        return (n for n in self.o.within(self.main) if self.roles[n] & set(roles))

    def _leave_frame(self) -> None:
        """Leave out what is about other services, and the page's frame."""
        o = self.o
        other = next((n for n in self.being("other") if o.leaf(n) and re.match(self.rules.related, o.label(n), re.I)), None)
        if other is not None:
            o.end_at(other, self.main)
        keeps = {  # what an element of a role must be for its texts to stay
            "hidden": lambda n: len(o.label(n, "")) >= 200 or o.has(n, {"ul", "ol", "table"}),
            "frame": lambda n: False,
            "trail": lambda n: o.has(n, {"h1"}),
        }
        for role, stays in keeps.items():
            for n in self.being(role):
                if not stays(n):
                    o.leave_out(n)

    # --- sections --------------------------------------------------------------------------------------------------
    def sections(self) -> Iterator[tuple[str, str]]:
        """(name, text) of every section, in the order: tabs, known ids, labels."""
        for find in (self.tabs, self.known, self.labels):
            for name, ranges in find():
                text = clean("\n".join(x for x in (self.o.body(*r) for r in ranges) if x))
                if text or find != self.labels:
                    yield name, text or ""

    def tabs(self) -> Iterator[tuple[str, list[tuple]]]:
        o = self.o
        sure = list(self.being("tab"))
        named = [n for n in self.being("anchor") if n not in sure and o.attrs[n].get("href", "").startswith("#") and len(o.label(n, "")) <= 40 and self.rules.label_field(o.label(n))]
        for tab in sure + named:
            refs = [o.attrs[tab].get(k, "").lstrip("#").strip() for k in TAB_POINTERS]
            panel = next((p for p in (o.find(self.main, r) for r in refs if r) if p is not None), None) if not o.gone[tab] else None
            if panel is None or panel <= tab < o.stop[panel]:
                continue
            name = clean(o.label(tab)) or ""
            for n in [n for n in o.within(panel) if o.leaf(n) and (clean(o.label(n)) or "") == name]:
                o.leave_out(n)
            yield name, [(o.first[panel], o.last[panel])]
            o.leave_out(panel)
        for n in list(self.being("tabs")):
            o.leave_out(n)

    def known(self) -> Iterator[tuple[str, list[tuple]]]:
        for own, name in SECTION_IDS.items():
            if (n := self.o.find(self.main, own)) is not None:
                yield name, [(self.o.first[n], self.o.last[n])]
                self.o.leave_out(n)

    def is_label(self, n: int) -> bool:
        o, roles = self.o, self.roles[n]
        if "head" in roles:
            return True
        if "lead" in roles:
            return o.leads(n) and len(o.label(n, "")) <= 60
        bare = "pair" in roles and not o.has(n, {"p", "div", "ul", "ol", "table"}) and o.followed(n)
        return bare and 0 < len(o.label(n)) <= 40 and self.rules.label_field(o.label(n)) is not None

    def labels(self) -> Iterator[tuple[str, list[tuple]]]:
        """A label's text runs to the end of what holds it, or to the part in which the next label stands."""
        o = self.o
        heads = [n for n in self.being("head", "lead", "pair") if self.is_label(n)]
        outer, inside = [], 0
        for n in heads:
            if n >= inside:
                outer.append(n)
                inside = o.stop[n]
        for n in outer:
            name = clean(o.label(n)) or ""
            if re.match(self.rules.stop, name, re.I):
                return
            lead = "lead" in self.roles[n] and "head" not in self.roles[n]
            block = o.up[n] if lead else n
            holder = o.up[block]
            if holder < 0:
                continue
            after = next(iter(heads[(at := bisect_left(heads, o.stop[block])) : at + 1]), None)
            end = o.last[holder]
            if after is not None and after < o.stop[holder]:
                end = o.first[next(k for k in (after, *o.above(after)) if o.up[k] == holder)]
            yield name, [*([(o.last[n], o.last[block])] if lead else []), (o.last[block], end, holder)]

    # --- description -------------------------------------------------------------------------------------------------
    def description(self) -> str | None:
        """The block that the page marks as one, outside of cards of other services; else the first long paragraph."""
        o = self.o
        noise = lambda t: re.search(self.rules.chrome, t, re.I)
        marked = (n for n in o.within(self.main) if any(re.search(DESCRIPTION_CLASS, c) for c in o.css(n).split()) and not any("list card" in self.roles[k] for k in o.above(n)))
        if found := next((t for n in marked if len(t := o.block(n)) >= 30 and not noise(t)), None):
            return found
        begin = next(self.having("h1"), self.main)
        for tags in (("p",), ("p", "div")):
            rows = (n for n in range(begin + 1, o.stop[self.main]) if not o.gone[n] and o.tags[n] in tags)
            plain = (n for n in rows if not o.has(n, {"p", "div"}) and not any(o.tags[k] in ("button", "a") for k in o.above(n)))
            if found := next((t for n in plain if len(t := clean(o.label(n)) or "") >= 40 and t != self.title and not noise(t)), None):
                return found
        return None


def own_text(text: str, rules: Rules) -> str:
    """A section's text without lines at its start that only repeat a heading; empty where it says nothing.

    Such a line is a label, a filler, or a label broken over two lines of which the second is short. The last line is
    never dropped. A word for nothing, and numbers alone, whose unit could only be guessed, say nothing.
    """
    lines = text.split("\n")
    while len(lines) > 1 and len(lines[0]) <= 40 and not lines[0].startswith("-"):
        one = rules.label_field(lines[0]) or lines[0].strip().lower() in FILLER_LINES
        two = len(lines[1]) <= 12 and rules.label_field(" ".join(lines[:2]))
        if not one and not two:
            break
        del lines[: 1 if one else 2]
    out = "\n".join(lines).strip()
    nothing = re.match(rules.placeholder, out, re.I) or re.match(r"^[\d\s|.,:\-–]*$", re.sub(rules.service_level, "", out, flags=re.I))
    return "" if nothing else out


def parse(markup: str | None, page_title: str | None, rules: Rules) -> dict[str, str | None]:
    """Fields of a page: its sections by the field that their name tells, texts of one field one after another."""
    page = Page(markup, rules)
    named = ((rules.label_field(name), own_text(text, rules)) for name, text in page.sections())
    out: dict[str, str] = {}
    for name, text in named:
        if name and text and text not in out.get(name, ""):
            out[name] = "\n".join(x for x in (out.get(name), text) if x)
    if "description" not in out and (text := page.description()):
        out["description"] = text
    title = page.title or (clean(re.split(r"\s[|\-–]\s", page_title)[0]) if page_title else None)
    return {"title": title} | out
