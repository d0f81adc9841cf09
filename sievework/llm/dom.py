"""A small HTML reader: blocks of text in page order and the tree of elements they stand in."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# A quote opens a value only behind "=" (and blanks); elsewhere it is a character like others.
_MARK = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)"
    r"|<[!?][^>]*+>?"
    r"|</[^A-Za-z>][^>]*+>?"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*+)"
    r"(?P<rest>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[\"'].*\Z|[^\s>]*+))?+)*+)(?P<end>>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")

# Element names as HTML defines their behaviour.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
UNSHOWN = ("annotation", "annotation-xml")
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td template tfoot th thead tr ul xmp".split()
)
_ENDS_P = BLOCK - {"button", "label", "legend", "option", "optgroup", "caption", "select", "template"} | {"hr"}
_ENDS_SELECT = _ENDS_P | {"select"}
# An element of the first kind ends an open one of the second, unless one of the third stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


@dataclass
class Node:
    name: str
    parent: int
    depth: int
    attributes: dict[str, str]
    chars: int = 0
    link_chars: int = 0
    children: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    title: str = ""
    links: list[str] = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] or ""
        out.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in "\"'" and value[:1] else value))
    return out


class _Builder:
    def __init__(self, links: bool) -> None:
        self.links = links
        self.page = Page([Node("#page", -1, 0, {})])
        self.stack: list[tuple[str, int]] = [("#page", 0)]  # element and the node its text belongs to
        self.open: dict[str, list[int]] = {}  # places on the stack, by name
        self.run: list[str] = []
        self.linked: list[str] = []
        self.at = 0

    def flush(self) -> None:
        """End the current run of text."""
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.page.blocks.append((self.at, text))
                node = self.page.nodes[self.at]
                node.chars += len(text)
                node.link_chars += min(len(text), len(" ".join("".join(self.linked).split())))
            self.run, self.linked = [], []

    def text(self, raw: str, decode: bool = True) -> None:
        """References are decoded run by run: a mark between two runs ends a reference."""
        if any(self.open.get(name) for name in UNSHOWN):
            return
        if decode and "&" in raw:
            raw = html.unescape(raw)
        node = self.stack[-1][1]
        if node != self.at:
            self.flush()
            self.at = node
        self.run.append(raw)
        if self.open.get("a"):
            self.linked.append(raw)

    def pop(self) -> str:
        name, node = self.stack.pop()
        if name:
            self.open[name].pop()
        if node != self.stack[-1][1]:
            self.flush()
        return name

    def close(self, name: str) -> None:
        """The end tag of a block ends all inside it, that of another element ends that one alone, as blocks are walls to it."""
        if not self.open.get(name):
            return
        if name in BLOCK:
            while self.pop() != name:
                pass
            return
        at = self.open[name].pop()
        self.stack[at] = ("", self.stack[at][1])
        while not self.stack[-1][0]:
            self.stack.pop()

    def start(self, name: str, raw: str) -> None:
        if name in _ENDS_P and self.open.get("p"):
            self.close("p")
        if name in _ENDS_SELECT and self.open.get("select"):
            self.close("select")
        if name in _ENDS:
            ended, walls = _ENDS[name]
            if any(self.open.get(e) for e in ended):
                for open_name, _ in reversed(self.stack):
                    if open_name in walls:
                        break
                    if open_name in ended:
                        self.close(open_name)
                        break
        if name == "a":
            self.close("a")
            if self.links and (link := attributes(raw).get("href")):
                self.page.links.append(link)
        if name == "br":
            self.text(" ")
        if name == "hr":
            self.flush()
        if name in VOID:
            return
        owner = self.stack[-1][1]
        if name in BLOCK:
            self.flush()
            nodes = self.page.nodes
            nodes[owner].children += 1
            nodes.append(Node(name, owner, nodes[owner].depth + 1, attributes(raw)))
            owner = len(nodes) - 1
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, owner))


def parse(source: str | None, links: bool = False) -> Page:
    """Tree, blocks, title and, if asked for, link targets of a page.

    Anything is a page: broken markup is read as browsers do, roughly; null is empty.  Text is left out only where browsers show none
    (scripts, styles, frames, text fields, annotations of formulas); all other elements are read and left to the model.
    """
    source = source or ""
    build = _Builder(links)
    at = 0
    while at < len(source):
        mark = source.find("<", at)
        if mark < 0:
            mark = len(source)
        if mark > at:
            build.text(source[at:mark])
        m = _MARK.match(source, mark)
        if m is None:
            if mark < len(source):
                build.text("<")
            at = mark + 1
            continue
        at = m.end()
        if m["name"] is None or m["end"] != ">":
            continue
        name = m["name"].lower()
        if m["close"]:
            if name == "br":
                build.text(" ")
            build.close(name)
        elif name in RAW or name == "xmp":
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            if name == "title" and not build.page.title:
                build.page.title = " ".join(html.unescape(inner).split())
            if name == "xmp":
                build.start(name, m["rest"])
                build.text(inner, decode=False)
                build.close(name)
            at = end.end() if end else len(source)
        else:
            build.start(name, m["rest"])
    build.flush()
    return build.page
