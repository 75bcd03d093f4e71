"""HTML to a sequence of leaf blocks, each with the path of tags it stands in."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|svg|iframe)\b(?P<raw_attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(?P<raw_text>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[a-z]+|\d+", re.I)
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag ends, and the elements that shield them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
NO_TEXT = frozenset(("script", "style", "template", "svg", "iframe", "noscript"))


class Node:
    """An open element: its names and the element around it, shared by all blocks inside."""

    __slots__ = ("names", "parent", "total", "around")

    def __init__(self, names: tuple[str, ...], parent: Node | None):
        self.names, self.parent, self.total, self.around = names, parent, None, None


@dataclass
class Leaf:
    """A block: its text, the innermost element it stands in and the share of its text in links."""

    text: str
    node: Node | None
    links: float


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    for key, a, b, c in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
            out.append("hidden")
        elif key != "style":
            out += [f".{w}" for w in NAME.findall(value)]
    return tuple(out)


def leaves(page: str) -> list[Leaf]:
    """The blocks of a page in order. Character references are decoded, white
    space runs are one space, ends are trimmed; blocks without text are left out."""
    out: list[Leaf] = []
    stack: list[tuple[str, Node]] = []
    parts: list[str] = []
    in_links = size = depth = 0

    def flush():
        nonlocal in_links, size
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Leaf(text, stack[-1][1] if stack else None, in_links / max(1, size)))
            parts.clear()
            in_links = size = 0

    def open_(tag: str, attrs: str):
        stack.append((tag, Node(_names(tag, attrs), stack[-1][1] if stack else None)))

    def close(at: int):
        nonlocal depth
        if any(t in BLOCK for t, _ in stack[at:]):
            flush()
        depth -= sum(t == "a" for t, _ in stack[at:])
        del stack[at:]

    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            parts.append(text)
            n = len(text.strip())
            size += n
            in_links += n * (depth > 0)
        elif m["raw"]:
            raw = m["raw"].lower()
            if raw in NO_TEXT:
                continue
            flush()
            parts.append(m["raw_text"])
            open_(raw, m["raw_attrs"])
            flush()
            stack.pop()
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["end"]:
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] == tag:
                        close(at)
                        break
                else:
                    if tag in BLOCK:
                        flush()
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in BLOCK:
                flush()
                for at in range(len(stack) - 1, -1, -1):  # a paragraph ends where a block begins
                    if stack[at][0] == "p":
                        close(at)
                        break
                    if stack[at][0] in BLOCK:
                        break
            if tag in ENDS:
                ended, shields = ENDS[tag]
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] in shields:
                        break
                    if stack[at][0] in ended:
                        close(at)
            if tag in VOID or m["attrs"].rstrip().endswith("/") and tag not in BLOCK:
                continue
            open_(tag, m["attrs"])
            depth += tag == "a"
    flush()
    return out
