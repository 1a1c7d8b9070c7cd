"""Leaf blocks of HTML pages: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never shown as text of the page.
HIDDEN = frozenset("head title script style template noscript svg iframe object textarea select option button canvas audio video math".split())
#: Any other start tag, and text, end the head.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Their content isn't markup.
RAW = frozenset("script style textarea title iframe noscript template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag that ends an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("ul ol dl table div section article main aside nav form body td th header footer".split())


@dataclass(eq=False)
class Element:
    tag: str
    words: frozenset = frozenset()  # of class, id, role and hidden attributes
    parent: Element | None = None
    context: object = None  # what a reader keeps about the element and its ancestors


@dataclass
class Block:
    text: str
    start: int  # of its first text in the source
    element: Element | None  # the innermost that holds it
    linked: int = 0  # characters inside links
    parts: list = field(default_factory=list)


_seen: dict[str, frozenset] = {}


def _words(attributes: str) -> frozenset:
    """Words of the attributes that tell what an element is for."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return frozenset()
    found = _seen.get(attributes)
    if found is None:
        out = set()
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                out.update(_WORD.findall(value))
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                out.add("hidden")
        found = frozenset(out)
        if len(_seen) > 50_000:
            _seen.clear()
        _seen[attributes] = found
    return found


def blocks(html: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    path: list[Element] = []
    now: Block | None = None
    hidden = links = 0
    opened: Counter = Counter()  # tags on the path
    at = 0

    def text(a: int, b: int) -> None:
        nonlocal now
        if a < b and path and path[-1].tag == "head" and html[a:b].strip(" \t\n\r\f"):
            leave_head()
        if a >= b or hidden:
            return
        piece = html[a:b]
        if "&" in piece:
            piece = unescape(piece)
        if now is None:
            if not piece.strip():
                return
            now = Block("", a, path[-1] if path else None)
        now.parts.append(piece)
        if links:
            now.linked += len(piece)

    def close() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                out.append(now)
            now = None

    def pop(to: int) -> None:
        nonlocal hidden, links
        while len(path) > to:
            e = path.pop()
            opened[e.tag] -= 1
            hidden -= e.tag in HIDDEN
            links -= e.tag == "a"

    def leave_head() -> None:
        while path and path[-1].tag == "head":
            pop(len(path) - 1)

    end = len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                close()
            for i in range(len(path) - 1, -1, -1) if opened[tag] else ():
                if path[i].tag == tag:
                    if tag in BLOCK or not any(e.tag in BLOCK for e in path[i + 1 :]):
                        pop(i)
                    else:  # an inline element that was left open inside blocks
                        e = path.pop(i)
                        opened[tag] -= 1
                        links -= e.tag == "a"
                    break
            continue
        if not m[4]:  # the page ends inside a tag
            break
        if tag not in IN_HEAD:
            leave_head()
        if tag in BLOCK:
            close()
            ended = {"p"} | CLOSES.get(tag, set())
            for i in range(len(path) - 1, -1, -1) if any(opened[t] for t in ended) else ():
                t = path[i].tag
                if t in ended:
                    pop(i)
                    break
                if t in _SCOPE:
                    break
        elif tag in ("br", "img", "wbr"):
            if now is not None and tag == "br":
                now.parts.append(" ")
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag != "a":
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*[^>]*>|\Z", re.IGNORECASE).search(html, at)
            at = max(stop.end(), at)
            continue
        path.append(Element(tag, _words(m[3]), path[-1] if path else None))
        opened[tag] += 1
        hidden += tag in HIDDEN
        links += tag == "a"
    close()
    return out
