"""A tolerant HTML reader: text blocks and media in page order, each with its open elements.

It follows what browsers do where that matters for text: comments, raw-text elements, omitted end tags, unknown tags and cut-off
pages are all accepted, and character references are decoded. It never fails on any string and is linear in its length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

#: Elements without content, whose content isn't text of the page, that flow within a block, and omitted end tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math object canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr blink".split())
CLOSES = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "thead": frozenset({"tr", "td", "th"}), "tbody": frozenset({"thead", "tbody", "tr", "td", "th"}), "tfoot": frozenset({"tbody", "tr", "td", "th"}), "option": frozenset({"option"}),
}
#: An omitted end tag is not looked for outside these.
_FENCE = frozenset("html body table ul ol dl div article section main aside nav header footer form blockquote figure td th".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_HREF = re.compile(r"(?<![^\s\"'/])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))", re.IGNORECASE)


@dataclass(slots=True)
class Element:
    name: str
    attrs: str
    parent: Element | None
    depth: int
    order: int

    def attributes(self) -> dict[str, str]:
        """Attributes by lower-case name, decoded; the first of a name counts."""
        found: dict[str, str] = {}
        for name, a, b, c in _ATTR.findall(self.attrs):
            found.setdefault(name.lower(), html.unescape(a or b or c))
        return found

    def lineage(self) -> Iterator[Element]:
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


@dataclass(slots=True)
class Block:
    """Text of one block, white space reduced to single spaces, or a media element; `at` is the innermost open block element."""

    at: Element
    text: str = ""
    links: int = 0  #: characters of the text that are in links
    media: Element | None = None
    path: int = 0  #: number of its tag path, where a caller numbers them


class Reader:
    """elements and blocks of a page; links (addresses of a elements, in order) and the first title."""

    def __init__(self, page: str | None, media: frozenset[str] = frozenset()) -> None:
        self.elements: list[Element] = []
        self.blocks: list[Block] = []
        self.links: list[str] = []
        self.title: str | None = None
        self._root = Element("", "", None, 0, -1)
        self._open = [self._root]  # block elements only
        self._places: dict[str, list[int]] = {}  # of open elements, by name, so that no search walks the whole stack
        self._fences: list[int] = []
        self._inline: list[str] = []
        self._parts: list[str] = []
        self._links = 0
        self._media = media
        self._read(page or "")

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append(Block(self._open[-1], text, min(self._links, len(text))))
            self._parts, self._links = [], 0

    def _text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            if "a" in self._inline:
                self._links += len(text.strip())
            self._parts.append(text)

    def _push(self, name: str, attrs: str) -> Element:
        top = self._open[-1]
        made = Element(name, attrs, top, top.depth + 1, len(self.elements))
        self.elements.append(made)
        return made

    def _descend(self, e: Element) -> None:
        at = len(self._open)
        self._open.append(e)
        self._places.setdefault(e.name, []).append(at)
        if e.name in _FENCE:
            self._fences.append(at)

    def _cut(self, at: int) -> None:
        """Closes the open elements from place `at` on."""
        while len(self._open) > at:
            name = self._open.pop().name
            self._places[name].pop()
            if name in _FENCE:
                self._fences.pop()

    def _close_omitted(self, name: str) -> None:
        """Ends open p elements and those that `name` ends, up to the nearest fence that it doesn't end."""
        gone = CLOSES.get(name, ())
        if not gone and not self._places.get("p"):
            return
        k = len(self._fences) - 1
        while k >= 0 and self._open[self._fences[k]].name in gone:
            k -= 1
        floor, least = self._fences[k] if k >= 0 else 0, len(self._open)
        for old in ("p", *gone):
            places = self._places.get(old)
            if places and places[-1] > floor:
                least = min(least, places[bisect_right(places, floor)])
        self._cut(least)

    def _start(self, name: str, attrs: str) -> None:
        if name in INLINE:
            if name == "a":
                self._inline.append(name)
                if m := _HREF.search(attrs):
                    self.links.append(html.unescape(m[1] or m[2] or m[3] or ""))
            return
        if name == "br":
            self._parts.append(" ")
            return
        if name in self._media:
            self._flush()
            self.blocks.append(Block(self._open[-1], media=self._push(name, attrs)))
            if name in VOID:
                return
        elif name in VOID:
            if name == "hr":
                self._flush()
            return
        self._flush()
        if name not in ("html", "body", "head"):
            self._close_omitted(name)
        elif name != "head" and self._places.get(name):
            return
        self._inline.clear()
        self._descend(self.elements[-1] if name in self._media else self._push(name, attrs))

    def _end(self, name: str) -> None:
        if name in INLINE:
            if name == "a" and self._inline:
                self._inline.pop()
            return
        if name == "br":
            self._parts.append(" ")
            return
        places = self._places.get(name)
        if places and (name in _FENCE or not self._fences or self._fences[-1] < places[-1]):
            self._flush()
            self._inline.clear()
            self._cut(places[-1])

    def _read(self, page: str) -> None:
        at, n, low = 0, len(page), None
        find, match, cut = page.find, _TOKEN.match, page[-1:] != ">"
        while at < n:
            i = find("<", at)
            if i < 0:
                self._text(page[at:])
                break
            m = match(page, i)
            if m is None or cut and m[2] and m.end() == n:
                m = _LOOSE.match(page, i)  # a quote that isn't closed, or a tag
            if m is None:
                self._text(page[at : i + 1])
                at = i + 1
                continue
            if i > at:
                self._text(page[at:i])
            at = m.end()
            end, name, attrs = m.groups()
            if not name:
                continue
            name = name.lower()
            if end:
                self._end(name)
            elif name in RAW and name not in self._media and not attrs.endswith("/"):
                if name not in ("svg", "math"):
                    self._flush()
                low = page.lower() if low is None else low
                if len(low) != n:  # lower-casing changed the length somewhere
                    end = next((x.start() for x in [re.compile(f"</{re.escape(name)}", re.I).search(page, at)] if x), n)
                else:
                    end = low.find(f"</{name}", at)
                    end = n if end < 0 else end
                if name == "title" and self.title is None:
                    self.title = " ".join(html.unescape(page[at:end]).split())
                close = page.find(">", end)
                at = n if close < 0 else close + 1
            else:
                self._start(name, attrs)
        self._flush()
