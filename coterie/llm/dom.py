"""A tolerant tree of a page's block elements with the text between them, read in one linear pass."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_VALUES = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+")
_ATTRS = re.compile(r"(?i)(?<![^\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HREF = re.compile(r"(?i)(?<![^\s\"'])href\s*=")
_PARTS = re.compile(r"[a-z]+")

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not markup; without an end tag script and style run to the end of the page.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Controls, drawings and stand-ins: never article text, but nodes of their own, so that one which is never
#: closed costs no text after it.
VOIDED = frozenset("button select datalist svg canvas object audio video noscript template".split())
CONTROLS = frozenset("input label button select option textarea".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: An end tag that is left out is looked for among so many open elements.
_LOOK_UP = 32


class Page:
    """Nodes in page order (a parent precedes its children), and pieces of text: (node, block, text), where
    the block number changes at every block boundary and line break."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.names = ["html"], [-1], [0], [frozenset()]
        self.pieces: list[tuple[int, int, str]] = []
        self.links, self.n_links, self.controls, self.voided = [0], [0], [0], [False]
        self._stack, self._open = [0], Counter()
        self._plain = False
        self._places: dict[str, tuple[list[int], list[int]]] = {}
        self._read(source)

    def _read(self, source: str) -> None:
        block, at, end = 0, 0, len(source)
        link_depth = 0  # of the stack, where a link is open
        last = source.rfind(">")
        while at < end:
            start = source.find("<", at)
            if start < 0:
                self._text(block, source[at:], link_depth)
                break
            m = _NAME.match(source, start + 1)
            if not m and source[start + 1 : start + 2] not in ("!", "?", "/"):  # a bare <
                self._text(block, source[at : start + 1], link_depth)
                at = start + 1
                continue
            if start > at:
                self._text(block, source[at:start], link_depth)
            if start >= last:  # a tag that never ends stops at the next one
                at = source.find("<", start + 1)
                at = at if at > 0 else end
                continue
            if not m:
                close = source.find("-->", start + 2) if source.startswith("<!--", start) else -1
                at = close + 3 if close >= 0 else source.find(">", start) + 1
                continue
            stop = self._tag_end(source, m.end())
            closing, name, attrs = m[1], m[2].lower(), source[m.end() : stop]
            at = stop + 1
            if name in RAW:
                if not closing and not attrs.endswith("/"):
                    ends = self._ends(source, name)[0]
                    k = bisect_right(ends, at - 1)
                    if k < len(ends):
                        at = ends[k]
                    elif name in ("script", "style"):
                        break
                continue
            self.controls[self._stack[-1]] += name in CONTROLS and not closing
            if name == "br":
                block += 1
            elif name == "a":
                link_depth = len(self._stack) if not closing and _HREF.search(attrs) else 0
                self.n_links[self._stack[-1]] += link_depth > 0
            if name in VOIDED:
                if closing:
                    self._close(name)
                elif not attrs.endswith("/"):
                    ends, starts = self._ends(source, name)
                    k, j = bisect_right(ends, at - 1), bisect_right(starts, start)
                    if k < len(ends) and not (j < len(starts) and starts[j] < ends[k]):
                        self._push(name, attrs)
            if name not in BLOCKS:
                continue
            block += 1
            if closing:
                self._close(name)
                if link_depth > len(self._stack):
                    link_depth = 0
                continue
            if self.tag[self._stack[-1]] == "p":
                self._pop_to(len(self._stack) - 1)
            if name in _CLOSED_BY and any(self._open[x] for x in _CLOSED_BY[name]):
                for k in range(len(self._stack) - 1, max(0, len(self._stack) - 1 - _LOOK_UP), -1):
                    if self.tag[self._stack[k]] in _STOPS[name]:
                        break
                    if self.tag[self._stack[k]] in _CLOSED_BY[name]:
                        self._pop_to(k)
                        break
            if link_depth > len(self._stack):
                link_depth = 0
            if name == "hr" or name == "body" and "body" in self.tag[:3]:
                continue
            self._push(name, attrs)

    def _tag_end(self, source: str, at: int) -> int:
        """Place of the > that ends a tag: not inside quotes, unless a quote never closes."""
        stop = source.find(">", at)
        if not self._plain and (source.find('"', at, stop) >= 0 or source.find("'", at, stop) >= 0):
            quoted = _VALUES.match(source, at).end()
            if source.startswith(">", quoted):
                return quoted
            self._plain = True
        return stop

    def _ends(self, source: str, name: str) -> tuple[list[int], list[int]]:
        """Places of the end tags and start tags of a name."""
        if name not in self._places:
            found = [(m.start(), m[1]) for m in re.finditer(rf"(?i)<(/?){name}(?=[\s/>])", source)]
            self._places[name] = [s for s, c in found if c], [s for s, c in found if not c]
        return self._places[name]

    def _push(self, name: str, attrs: str) -> None:
        up = self._stack[-1]
        self.tag.append(name)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        found = _ATTRS.findall(attrs) if attrs else ()
        self.names.append(frozenset(w for x in found for w in _PARTS.findall("".join(x).lower())))
        self.links.append(0)
        self.n_links.append(0)
        self.controls.append(0)
        self.voided.append(self.voided[up] or name in VOIDED)
        self._stack.append(len(self.tag) - 1)
        self._open[name] += 1

    def _pop_to(self, k: int) -> None:
        for node in self._stack[k:]:
            self._open[self.tag[node]] -= 1
        del self._stack[k:]

    def _close(self, name: str) -> None:
        if self._open[name]:
            k = len(self._stack) - 1
            while self.tag[self._stack[k]] != name:
                k -= 1
            self._pop_to(k)

    def _text(self, block: int, text: str, in_link: int) -> None:
        if "&" in text:
            text = html.unescape(text)
        node = self._stack[-1]
        self.pieces.append((node, block, text))
        if in_link:
            self.links[node] += len(text.strip())

    def text(self, keep: list[bool]) -> str:
        """The kept nodes' own text: white space to single spaces, blocks on lines of their own."""
        lines, current, number = [], [], None
        for node, block, piece in self.pieces:
            if keep[node]:
                if block != number:
                    lines.append(" ".join("".join(current).split()))
                    current, number = [], block
                current.append(piece)
        lines.append(" ".join("".join(current).split()))
        return "\n".join(x for x in lines if x)
