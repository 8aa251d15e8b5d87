"""A tolerant HTML tokenizer that yields the leaf blocks of a page in page order."""

from __future__ import annotations

import re
from html import unescape

#: no markup inside: they end at their end tag or with the page
_RAW = "script|style|title|textarea|iframe"
#: not shown: dropped up to their end tag, and nothing is dropped if there is none
_HIDDEN = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("noscript", "template", "svg", "select")}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({_RAW})(?=[\s/>])(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = BLOCK_TAGS - {"button", "caption", "dd", "dt", "label", "legend", "li", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "head", "html"}
#: an opening tag closes open ones of its kind, up to the container
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"form"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}


class Block:
    """Text between two borders of block elements, with the path of (tag, marks) that holds it."""

    __slots__ = ("text", "path", "links")

    def __init__(self, text: str, path: tuple, links: int):
        self.text, self.path, self.links = text, path, links


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    in_link, links, at = False, 0, 0
    endless: set[str] = set()

    def flush():
        nonlocal links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(stack), min(links, len(text))))
            parts.clear()
        links = 0

    def add(text: str):
        nonlocal links
        if text:
            parts.append(text)
            if in_link:
                links += len(text.strip())

    while m := TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if tag is None:
            continue
        tag, closing = tag.lower(), (m[2] or m[5]) == "/"
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _HIDDEN:
            if not closing and tag not in endless and not (tag == "svg" and (m[4] or m[7] or "").endswith("/")):
                end = _HIDDEN[tag].search(html, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            in_link = False
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in ("td", "th", "button", "li", "div", "section", "article", "main", "body", "blockquote", "form", "aside"):
                    break
        if tag in _CLOSES:
            own, fence = _CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in fence:
                    break
                if stack[k][0] in own:
                    del stack[k:]
                    break
        attributes = m[4] or m[7]
        marks = " ".join((a or b or c).lower() for a, b, c in _MARK.findall(attributes)) if attributes else ""
        stack.append((tag, marks))
    add(html[at:])
    flush()
    return out
