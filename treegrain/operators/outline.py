"""Outlines: headings with bodies and nested lists, flattened into chunk rows. Shared by the parsers of marked-up documents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

_OTHER = re.compile(r"[^a-z0-9]+")


def slugify(title: str, *, fold_accents: bool = False, limit: int = 32) -> str:
    """The Python twin of functions.text.slug()."""
    if fold_accents:
        title = fold(title)
    return (_OTHER.sub("-", title.lower()).strip("-")[:limit] or "section").rstrip("-")


def fold(text: str) -> str:
    """Without combining accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Mn")


@dataclass
class Item:
    text: str
    items: list[Item] = field(default_factory=list)


@dataclass
class Heading:
    level: int
    title: str
    kind: str = ""
    body: list[str] = field(default_factory=list)
    items: list[Item] = field(default_factory=list)
    below: list[Heading] = field(default_factory=list)


class Outline:
    """Headings in order of appearance; a heading closes all open ones of its own or a deeper level."""

    def __init__(self) -> None:
        self.top: list[Heading] = []
        self.open: list[Heading] = []

    def add(self, heading: Heading) -> None:
        while self.open and self.open[-1].level >= heading.level:
            self.open.pop()
        (self.open[-1].below if self.open else self.top).append(heading)
        self.open.append(heading)

    @property
    def current(self) -> Heading | None:
        return self.open[-1] if self.open else None

    def base_level(self) -> int:
        """Level of the nearest open heading that isn't a numbered one, 0 without any."""
        return next((h.level for h in reversed(self.open) if h.kind != "numbered"), 0)


@dataclass
class Row:
    """One chunk of a document; local_id counts from 0 in order of emission."""

    local_id: int
    text: str
    depth: int
    node_path: str
    source_file: str
    start_line: int = 1
    end_line: int = 1


class Rows(list):
    def put(self, path: str, depth: int, lines: list[str], source: str, start: int = 1, end: int = 1) -> None:
        self.append(Row(len(self), "\n".join(lines), depth, path, source, start, end))


def flatten(outline: Outline, rows: Rows, *, root: str, source: str, separator: str, min_chars: int, fold_accents: bool = False, drop_short_leaves: bool = False) -> None:
    """Depth first: a heading, the headings below it, then its list items. Works with an explicit stack, so depth is no limit."""
    work: list[tuple] = [("heading", h, root, 0) for h in reversed(outline.top)]
    while work:
        what, x, above, depth, *rest = work.pop()
        if what == "heading":
            path = f"{above}.{slugify(x.title, fold_accents=fold_accents)}"
            body = separator.join(x.body).strip("\n" if separator == "\n" else None)
            if drop_short_leaves and not body and not x.below and len(x.title) < min_chars:
                continue
            rows.put(path, depth + 1, [path, x.title, *(["", body] if body else [])], source)
            work += [("item", i, path, depth + 1, n, x.title) for n, i in reversed(list(enumerate(x.items, 1)))]
            work += [("heading", h, path, depth + 1) for h in reversed(x.below)]
        else:
            n, title = rest
            if not x.items and len(x.text) < min_chars:
                continue
            path = f"{above}.li{n}"
            rows.put(path, depth + 1, [path, f"{title} (item {n})", "", x.text], source)
            work += [("item", i, path, depth + 1, k, f"{title} item {n}") for k, i in reversed(list(enumerate(x.items, 1)))]


def ancestors_exist(rows: list[Row]) -> Iterator[str]:
    """Paths whose parent path no row has (the root aside)."""
    known = {r.node_path for r in rows}
    for r in rows:
        parent = r.node_path.rpartition(".")[0]
        if parent and parent not in known:
            yield r.node_path
