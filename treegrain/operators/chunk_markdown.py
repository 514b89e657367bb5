"""Markdown into headings and list items."""

from __future__ import annotations

import re

from treegrain.operators.outline import Heading, Item, Outline, Row, Rows, flatten

_ATX = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*$")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_BULLET = re.compile(r"(\s*)(?:[-*+]|\d+[.)])\s+(.*)$")
_UNDERLINE = {"=": re.compile(r"=+\s*$"), "-": re.compile(r"-+\s*$")}


def list_items(lines: list[str]) -> list[Item]:
    """Nested items of a block of list lines: indents (tabs to multiples of 4) count by rank within the block; other lines continue the item before."""
    flat: list[tuple[int, list[str]]] = []
    for line in lines:
        m = _BULLET.match(line)
        if m:
            flat.append((len(m[1].expandtabs(4)), [m[2].strip()]))
        elif flat and line.strip():
            flat[-1][1].append(line.strip())
    rank = {indent: k for k, indent in enumerate(sorted({i for i, _ in flat}))}
    top: list[Item] = []
    line_of_descent: list[tuple[int, Item]] = []
    for indent, parts in flat:
        item = Item(" ".join(parts).strip())
        while line_of_descent and line_of_descent[-1][0] >= rank[indent]:
            line_of_descent.pop()
        (line_of_descent[-1][1].items if line_of_descent else top).append(item)
        line_of_descent.append((rank[indent], item))
    return top


def markdown_rows(text: str, *, title: str | None = None, root: str = "doc", min_chars: int = 40, include_lists: bool = True) -> list[Row]:
    """Root, ATX and setext headings, list items; fenced code stays in the body as it is. Text before the first heading is left out."""
    lines = (text or "").splitlines()
    outline, block = Outline(), []
    fence: str | None = None
    skip = False

    def end_block() -> None:
        if block and outline.current is not None and include_lists:
            outline.current.items += list_items(block)
        block.clear()

    def say(line: str) -> None:
        if outline.current is not None and line.strip():
            outline.current.body.append(line)

    for n, line in enumerate(lines):
        if skip:
            skip = False
            continue
        bare = line.strip()
        mark = _FENCE.match(line)
        if mark:
            kind = mark[1][:3]
            if fence is None:
                end_block()
                fence = kind
            elif bare.startswith(fence):
                fence = None
            say(line)
        elif fence is not None:
            say(line)
        elif atx := _ATX.match(line):
            end_block()
            outline.add(Heading(len(atx[1]), atx[2].strip()))
        elif bare and n + 1 < len(lines) and not _BULLET.match(line) and (under := next((c for c, r in _UNDERLINE.items() if r.match(lines[n + 1])), None)):
            end_block()
            outline.add(Heading(1 if under == "=" else 2, bare))
            skip = True
        elif _BULLET.match(line):
            block.append(line)
        elif not bare:
            end_block()
        elif block and line[0] in " \t":
            block.append(line)
        else:
            end_block()
            say(bare)
    end_block()

    def first_title(headings: list[Heading]) -> str | None:
        return next((h.title for h in headings if h.level == 1), None)

    # A first-level heading is never below another, so the first among the top ones is the document's first.
    rows = Rows()
    rows.put(root, 0, [root, title or first_title(outline.top) or "Document"], "<markdown>", 1, len(lines) or 1)
    flatten(outline, rows, root=root, source="<markdown>", separator="\n", min_chars=min_chars)
    return rows
