"""A lenient element tree on the standard library's HTML tokenizer: end tags close the nearest open element of their name or nothing; nothing is implied."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr".split())


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Element):
                stack += reversed(c.children)
            elif c is not None:
                yield c

    def text(self, separator: str = " ") -> str:
        """All strings below, each stripped, empty ones left out."""
        return separator.join(s for s in (x.strip() for x in self.strings()) if s)

    def raw_text(self) -> str:
        return "".join(self.strings())

    def within(self, *tags: str) -> bool:
        e = self.parent
        while e is not None:
            if e.tag in tags:
                return True
            e = e.parent
        return False

    def direct(self, *tags: str) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element) and c.tag in tags]

    def first(self, *tags: str) -> Element | None:
        return next((e for e in self.walk() if e.tag in tags), None)

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()

    def remove(self, test) -> None:
        """Take out every element below for which test holds, with all it contains."""
        stack = [self]
        while stack:
            e = stack.pop()
            e.children = [c for c in e.children if not (isinstance(c, Element) and test(c))]
            stack += [c for c in e.children if isinstance(c, Element)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, dict(attrs), self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        own = self.at.children
        if own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)

    def _other(self, data):
        self.at.children.append(None)  # parts the text on either side, as it stands between them

    handle_comment = handle_decl = handle_pi = unknown_decl = _other


def parse(page: str) -> Element:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root
