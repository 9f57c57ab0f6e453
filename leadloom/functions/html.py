"""A small tree of an HTML page, from the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "depth")

    def __init__(self, tag: str, attrs=(), parent=None):
        self.tag, self.parent, self.children = tag, parent, []
        self.attrs = {}
        for k, v in attrs:
            self.attrs.setdefault(k, v or "")
        self.depth = parent.depth + 1 if parent else 0

    def walk(self):
        """All elements below, in document order; no recursion, so depth doesn't matter."""
        stack = [x for x in reversed(self.children) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.children) if isinstance(x, Node)]

    def find_all(self, *tags: str, attr: str | None = None):
        return [n for n in self.walk() if (not tags or n.tag in tags) and (attr is None or attr in n.attrs)]

    def strings(self):
        """Stripped pieces of text, without those of scripts and styles."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                if x.tag not in ("script", "style", "template"):
                    stack += reversed(x.children)
            elif s := x.strip():
                yield s

    def text(self) -> str:
        return " ".join(self.strings())

    def above(self):
        node = self.parent
        while node:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, attrs, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def hrefs(html: str | None) -> list[str]:
    return [h for n in parse(html).find_all("a", attr="href") if (h := n.attrs["href"].strip())]
