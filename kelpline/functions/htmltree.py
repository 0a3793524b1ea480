"""A small HTML tree on the standard parser: enough for loaders and the HTML chunker."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, and elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: an open element that the key closes implicitly
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: "Node | None" = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self) -> Iterator["Node"]:
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def find(self, *tags: str) -> "Node | None":
        return next((n for n in self.walk() if n.tag in tags), None)

    def find_all(self, *tags: str) -> list["Node"]:
        return [n for n in self.walk() if n.tag in tags]

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def texts(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, Node):
                yield from child.texts()
            else:
                yield child

    def text(self, separator: str = "") -> str:
        return separator.join(t for x in self.texts() if (t := x.strip()))

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        while self.at.tag in shut:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(text: str) -> Node:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root
