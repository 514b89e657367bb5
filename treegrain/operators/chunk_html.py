"""HTML pages into headings and list items."""

from __future__ import annotations

from treegrain.operators.dom import Element, parse
from treegrain.operators.outline import Heading, Item, Outline, Row, Rows, flatten

_REMOVED = frozenset(["script", "style", "nav", "footer", "aside"])
_LISTS = ("ol", "ul")


def _items(element: Element) -> list[Item]:
    """Items of a list: the direct text of each, and lists that are direct children of it."""
    out = []
    for li in element.direct("li"):
        own = [c.strip() if isinstance(c, str) else c.text() for c in li.children if c is not None and not (isinstance(c, Element) and c.tag in _LISTS)]
        item = Item(" ".join(x for x in own if x), [i for nested in li.direct(*_LISTS) for i in _items(nested)])
        if item.text or item.items:
            out.append(item)
    return out


def html_rows(page: str, *, title: str | None = None, root: str = "doc", min_chars: int = 40, list_items: bool = True) -> list[Row]:
    """Root, headings (paragraphs of their section in order) and the items of outermost lists. Text before the first heading is left out."""
    tree = parse(page)
    tree.remove(lambda e: e.tag in _REMOVED)
    outline = Outline()
    for e in tree.walk():
        if len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1] in "123456":
            outline.add(Heading(int(e.tag[1]), e.text()))
        elif outline.current is None:
            continue
        elif e.tag == "p":
            if text := e.text():
                outline.current.body.append(text)
        elif e.tag in _LISTS and list_items and not e.within(*_LISTS):
            outline.current.items += _items(e)
    named = tree.first("title")
    rows = Rows()
    rows.put(root, 0, [root, title or (named.text("") if named else "") or "Document"], "<html>")
    flatten(outline, rows, root=root, source="<html>", separator="\n", min_chars=min_chars)
    return rows
