"""Pages as trees of elements with their own text, from a scan over the tags."""

from __future__ import annotations

import html
import re
from bisect import bisect_right

#: HTML element classes. Fixed values, as the HTML standard gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript template svg math object canvas".split())
ESCAPABLE = frozenset("title textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Start tags that end an open element of these names, up to the nearest element of the third column.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag doesn't reach past these.
SCOPE = frozenset("html body table td th caption object template".split())

_MARK = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<bogus>[!?][^>]*>?)|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


class Node:
    """An element: its parent's number, name, attributes, and its own text with the places of its children."""

    __slots__ = ("attrs", "depth", "name", "own", "parent", "raw")

    def __init__(self, parent: int, depth: int, name: str, attrs: str):
        self.parent, self.depth, self.name, self.raw, self.own, self.attrs = parent, depth, name, attrs, 0, None

    def attributes(self) -> dict[str, str]:
        if self.attrs is None:
            self.attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(self.raw)} if self.raw.strip(" /\n\t") else {}
        return self.attrs


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(elements in page order, pieces of text in page order).

    A piece is (number of its element, text with references decoded), or (-1, "") where a block begins or ends. Scripts,
    styles and comments leave nothing.
    """
    nodes = [Node(-1, 0, "#page", "")]
    pieces: list[tuple[int, str]] = []
    open_ = [0]
    #: Places in open_ of each name's open elements, and of those in SCOPE: no tag makes the stack be searched.
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    at, n = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a:
            t = page[a:b]
            if "&" in t:
                t = html.unescape(t)
            nodes[open_[-1]].own += len(t.strip())
            pieces.append((open_[-1], t))

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    def opened(name: str) -> None:
        places.setdefault(name, []).append(len(open_))
        if name in SCOPE:
            scopes.append(len(open_))
        open_.append(len(nodes) - 1)

    def close(k: int) -> None:
        block = False
        while len(open_) > k:
            name = nodes[open_.pop()].name
            places[name].pop()
            if name in SCOPE:
                scopes.pop()
            block |= name not in INLINE
        if block:
            pieces.append((-1, ""))

    while at < n:
        less = page.find("<", at)
        if less < 0:
            text(at, n)
            break
        m = _MARK.match(page, less)
        if not m:
            text(at, less + 1)
            at = less + 1
            continue
        text(at, less)
        at = m.end()
        if m["end"]:
            name = m["end"].lower()
            if name == "br":
                pieces.append((-1, ""))
            k = last(name)
            if k > 0 and k >= (scopes[-1] if scopes else 0):
                close(k)
        elif m["start"]:
            name = m["start"].lower()
            if name == "body" and places.get("body"):
                continue
            if name in CLOSES_P:
                if (k := last("p")) > (scopes[-1] if scopes else 0):
                    close(k)
            elif name in ENDS:
                ended, stop = ENDS[name]
                barrier = max(0, *(last(x) for x in stop))
                if name == "li":
                    above = [k for k in (last("li"),) if k > barrier]
                else:  # the outermost one inside the barrier
                    above = [row[i] for x in ended if (row := places.get(x)) and (i := bisect_right(row, barrier)) < len(row)]
                if above:
                    close(min(above))
            if name not in INLINE:
                pieces.append((-1, ""))
            if name in VOID:
                continue
            nodes.append(Node(open_[-1], len(open_), name, m["attrs"]))
            if name in RAW or name in ESCAPABLE:
                if m["attrs"].endswith("/") and name in ("svg", "math"):
                    continue
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                upto = end.start() if end else n
                if name in ESCAPABLE:
                    open_.append(len(nodes) - 1)
                    text(at, upto)
                    open_.pop()
                    pieces.append((-1, ""))
                at = end.end() if end else n
                continue
            opened(name)
    return nodes, pieces


def joined(pieces: list[tuple[int, str]], kept: set[int] | list[bool]) -> str:
    """Text of the kept elements: blocks apart by one space, white space inside as one space, trimmed."""
    out = []
    for i, t in pieces:
        out.append(" " if i < 0 else t if kept[i] else " ")
    return " ".join("".join(out).split())
