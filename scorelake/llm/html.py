"""A small tolerant reader of HTML: elements with their open ancestors, and blocks of text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title|svg|iframe)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))")
_SPACE = re.compile(r"\s+")

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul".split())
# A start tag of the first kind ends an open element of the second.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "title"}


class Node(NamedTuple):
    tag: str
    names: tuple[str, ...]  # words of its class and id
    style: str  # tag and class, as it shows


class Event(NamedTuple):
    kind: str  # "open", "text" or "break"
    path: list[Node]  # open elements; for "open" the last is the new one
    text: str


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(raw)}


def node(tag: str, raw: str) -> Node:
    if not raw or "=" not in raw:
        return Node(tag, (), tag)
    found = attributes(raw)
    shown = " ".join(sorted(found.get("class", "").lower().split()))
    names = tuple(re.split(r"[\s_\-:]+", f"{shown} {found.get('id', '').lower()} {found.get('role', '').lower()}".strip()))
    return Node(tag, names, f"{tag}.{shown}" if shown else tag)


def events(page: str) -> Iterator[Event]:
    """Openings, texts and block breaks of a page in order. The path is shared and changes; read it at once.

    The contents of scripts, styles and the like are skipped, as are comments. Elements that are
    left open end with the parent; end tags without a start are ignored.
    """
    path: list[Node] = []
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield Event("text", path, page[at:m.start()])
        at = m.end()
        if m[5] is None:
            continue
        tag = m[5].lower()
        if m[4]:
            depth = next((i for i in range(len(path) - 1, -1, -1) if path[i].tag == tag), None)
            if depth is not None:
                del path[depth:]
            if tag in BLOCKS:
                yield Event("break", path, "")
            continue
        ends = _ENDS.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        if ends and path:
            for i in range(len(path) - 1, -1, -1):
                if path[i].tag in ends:
                    del path[i:]
                    break
                if path[i].tag in BLOCKS:
                    break
        if tag in BLOCKS:
            yield Event("break", path, "")
        if tag == "br":
            yield Event("text", path, " ")
        if tag in VOID:
            continue
        path.append(node(tag, m[6]))
        yield Event("open", path, "")
    if at < len(page):
        yield Event("text", path, page[at:])


def clean(parts: list[str]) -> str:
    """One block: references decoded, white space made one space, trimmed."""
    text = "".join(parts)
    if "&" in text:
        text = html.unescape(text)
    return _SPACE.sub(" ", text).strip()


def title_of(page: str) -> str:
    m = re.search(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", page, re.S | re.I)
    return clean([m[1]]) if m else ""


def links_of(page: str) -> list[str]:
    """Targets of all anchors in order."""
    return [found["href"] for m in _TOKEN.finditer(page) if m[5] and not m[4] and m[5].lower() == "a" and "href" in (found := attributes(m[6]))]


def all_blocks(page: str) -> list[str]:
    """The visible text blocks of a page in order."""
    out: list[str] = []
    parts: list[str] = []
    for e in events(page):
        if e.kind == "text":
            parts.append(e.text)
        elif e.kind == "break" and parts:
            out.append(clean(parts))
            parts = []
    out.append(clean(parts))
    return [b for b in out if b]
