"""A small tree of HTML and selectors by tag, class and attribute; what is not closed or not opened is tolerated."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that begin and end a line of text, and elements without text of their own.
_LINES = frozenset("p div li ul ol section br h1 h2 h3 h4 h5 h6 tr table article".split())
_SILENT = frozenset("script style noscript".split())
#: An element of these closes an open one of the same kind, and is closed by a new one only inside its own list.
_SIBLINGS = {"li": ("ul", "ol"), "p": ("div", "li", "body", "section"), "tr": ("table",), "td": ("tr",)}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.inside: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        for x in self.inside:
            if isinstance(x, Node):
                yield x
                yield from x.walk()

    def _pieces(self, without: frozenset[Node] = frozenset()) -> Iterator[str]:
        for x in self.inside:
            if isinstance(x, str):
                yield x
            elif x.tag not in _SILENT and x not in without:
                edge = "\n" if x.tag in _LINES else " "
                yield edge
                yield from x._pieces(without)
                yield edge

    def lines(self, without: frozenset[Node] = frozenset()) -> str:
        """Text with a line for each block, each trimmed of blanks, dashes and colons at its ends."""
        rows = (re.sub(r"\s+", " ", row).strip(" -:\t") for row in "".join(self._pieces(without)).replace("\xa0", " ").split("\n"))
        return "\n".join(r for r in rows if r)

    def text(self, without: frozenset[Node] = frozenset()) -> str:
        return " ".join(self.lines(without).split())

    def all(self, selector: str) -> Iterator[Node]:
        """Nodes below this one by `tag.class.class[attribute*=part]`; tag may be missing."""
        tag, classes, attribute, part = _selector(selector)
        for n in self.walk():
            if (not tag or n.tag == tag) and classes <= set(n.attrs.get("class", "").split()) and (not attribute or part in n.attrs.get(attribute, "") and attribute in n.attrs):
                yield n

    def first(self, *path: str) -> Node | None:
        """The first node by a path of selectors, each inside the one before."""
        for n in self.all(path[0]):
            if len(path) == 1:
                return n
            if (found := n.first(*path[1:])) is not None:
                return found
        return None


def _selector(selector: str) -> tuple[str, set[str], str, str]:
    head, _, rest = selector.partition("[")
    attribute, _, part = rest.rstrip("]").partition("*=")
    tag, *classes = head.split(".")
    return tag, set(classes), attribute, part


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _SIBLINGS:
            n = self.at
            while n.parent is not None and n.tag != tag and n.tag not in _SIBLINGS[tag]:
                n = n.parent
            if n.tag == tag and n.parent is not None:
                self.at = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.inside.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.inside.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def content(root: Node, name: str) -> str:
    """The content of a meta property or name."""
    for n in root.all("meta"):
        if name in (n.attrs.get("property"), n.attrs.get("name")):
            return " ".join(n.attrs.get("content", "").split())
    return ""


def json_blocks(root: Node) -> Iterator[Any]:
    """Every JSON-LD block that can be read."""
    for n in root.all("script[type*=application/ld+json]"):
        try:
            yield json.loads("".join(x for x in n.inside if isinstance(x, str)))
        except ValueError:
            continue


def objects(value: Any) -> Iterator[dict]:
    """All objects in a JSON value, however deep, from the outside in."""
    stack = [value]
    while stack:
        x = stack.pop(0)
        if isinstance(x, dict):
            yield x
            stack[:0] = list(x.values())
        elif isinstance(x, list):
            stack[:0] = x


def job_description(root: Node, least: int = 60) -> str:
    """The description of the first object, at any depth, whose type speaks of a job posting and whose text is long enough."""
    for block in json_blocks(root):
        for x in objects(block):
            kinds = x.get("@type")
            if "jobposting" in "".join(map(str, kinds if isinstance(kinds, list) else [kinds])).lower() and isinstance(x.get("description"), str):
                if len(found := tree(x["description"]).text()) >= least:
                    return found
    return ""


def page_text(html: str | None, most: int = 12_000) -> str:
    """A page's structured description or else all of its text, cut to most characters."""
    root = tree(html)
    return (job_description(root) or root.text())[:most]
