"""A lenient tree of HTML on the standard library's parser; no Spark here.

Rules: void elements have no children; p ends at the next block, li, td, th, tr, dt, dd and option at
the next of their kind; an end tag closes up to its element and is ignored where none is open; script
and style hold text only. A page without any element has no tree.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select body html div".split())
UNSEEN = frozenset(("script", "style", "noscript", "template"))


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: "Node | None"
    depth: int
    position: int
    children: list["Node"] = field(default_factory=list)
    parts: list = field(default_factory=list)  # own text and children, in order

    def text(self) -> str:
        """Text of the element without scripts and styles."""
        out: list[str] = []
        stack = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in UNSEEN:
                stack.extend(reversed(x.parts))
        return " ".join(" ".join(out).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.open: list[Node] = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK and self.open and self.open[-1].tag == "p":
            self.open.pop()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in ENDS.get(tag, ()):
                del self.open[i:]
                break
            if self.open[i].tag in SCOPE:
                break
        parent = self.open[-1] if self.open else None
        node = Node(tag, {k: v or "" for k, v in attrs}, parent, parent.depth + 1 if parent else 0, len(self.nodes))
        self.nodes.append(node)
        if parent:
            parent.children.append(node)
            parent.parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1] is self.nodes[-1]:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open and data.strip():
            self.open[-1].parts.append(data)


def parse(page: str | None, most: int | None = None) -> list[Node] | None:
    """All elements in document order, or None; of the first ``most`` characters where a limit is asked for."""
    if not page or not page.strip():
        return None
    builder = _Builder()
    builder.feed(page if most is None else page[:most])
    builder.close()
    return builder.nodes or None


def roots(nodes: list[Node]) -> list[Node]:
    return [n for n in nodes if n.parent is None]


def page_text(nodes: list[Node]) -> str:
    return " ".join(x for x in (r.text() for r in roots(nodes)) if x)


def runs(nodes: list[Node]) -> list[tuple[str, str, int]]:
    """Runs of at least three siblings alike: their tag, their children's tags joined by + (40 characters), how many."""
    out = []
    for node in nodes:
        if len(node.children) >= 3:
            found = Counter((c.tag, "+".join(x.tag for x in c.children)[:40]) for c in node.children)
            out += [(tag, kids, n) for (tag, kids), n in found.items() if n >= 3]
    return out


def repeats(nodes: list[Node]) -> list[tuple[str, int]]:
    """The runs by signature, ``tag(children)``, the largest first."""
    return sorted(((f"{tag}({kids})", n) for tag, kids, n in runs(nodes)), key=lambda x: (-x[1], x[0]))


def without_boilerplate(nodes: list[Node], words: tuple[str, ...], tags: tuple[str, ...] = ("nav", "footer", "header", "aside", "form", "script", "style", "noscript", "iframe", "svg", "button")) -> list[Node]:
    """Elements that are not, and do not lie in, a boilerplate tag, a hidden element or one whose class, id, role or label holds a word."""
    gone: set[int] = set()
    for n in nodes:
        names = " ".join(n.attrs.get(k, "") for k in ("class", "id", "role", "aria-label")).lower()
        hidden = "hidden" in n.attrs or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", n.attrs.get("style", "")) is not None
        if (n.parent and id(n.parent) in gone) or n.tag in tags or hidden or any(w in names for w in words):
            gone.add(id(n))
    return [n for n in nodes if id(n) not in gone]


def main_content(nodes: list[Node], words: tuple[str, ...], least: int = 200) -> str:
    """The longest text among article, main, role=main and content-like elements, if it has ``least`` characters; else all that is left."""
    left = without_boilerplate(nodes, words)
    ids = {id(n) for n in left}
    # words of each element and their characters, from the last element to the first, so that children come before parents
    size: dict[int, tuple[int, int]] = {}
    for n in reversed(left):
        parts = [(len(w), sum(map(len, w))) if isinstance(x, str) and (w := x.split()) is not None else size.get(id(x), (0, 0)) for x in n.parts]
        size[id(n)] = sum(k for k, _ in parts), sum(c for _, c in parts)

    def text(n: Node) -> str:
        out: list[str] = []
        stack: list = [n]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out += x.split()
            elif id(x) in ids:
                stack.extend(reversed(x.parts))
        return " ".join(out)

    likely = [n for n in left if n.tag in ("article", "main") or n.attrs.get("role") == "main" or re.search(r"\b(content|article|post|entry)\b", f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower())]
    length = lambda n: max(0, size[id(n)][1] + size[id(n)][0] - 1)
    best = max(likely, key=length, default=None)
    if best is not None and length(best) >= least:
        return text(best)
    return " ".join(x for x in (text(n) for n in left if n.parent is None or id(n.parent) not in ids) if x)


def markdownish(nodes: list[Node], most: int | None = None) -> str:
    """Lines of text, one for each block; links and images leave only their text."""
    lines: list[list[str]] = [[]]
    end = object()
    stack: list = list(reversed(roots(nodes)))
    while stack:
        x = stack.pop()
        if x is end:
            lines.append([])
        elif isinstance(x, str):
            lines[-1].append(x)
        elif x.tag not in UNSEEN and x.tag not in ("head", "meta", "link"):
            if x.tag in BLOCK or x.tag == "br":
                lines.append([])
                stack.append(end)
            if x.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                lines[-1].append("#" * int(x.tag[1]) + " ")
            elif x.tag == "li":
                lines[-1].append("* ")
            stack.extend(reversed(x.parts))
    out = "\n".join(x for x in (" ".join("".join(line).split()) for line in lines) if x)
    return out if most is None else out[:most]


def heading_fields(nodes: list[Node], most: int | None = None) -> dict:
    """Title, descriptions, headings (the first ``most`` of them, if asked) and body text for weighting."""
    first = lambda tag: next((n.text() for n in nodes if n.tag == tag), "")
    metas = {(n.attrs.get("name") or n.attrs.get("property") or "").lower(): n.attrs.get("content", "") for n in reversed(nodes) if n.tag == "meta"}
    body = next((n for n in nodes if n.tag == "body"), None)
    return {
        "title": first("title"), "description": metas.get("description", ""), "keywords": metas.get("keywords", ""), "og_title": metas.get("og:title", ""), "og_description": metas.get("og:description", ""),
        "headings": [n.text() for n in nodes if n.tag in ("h1", "h2", "h3")][:most], "body": body.text() if body else page_text(nodes),
    }
