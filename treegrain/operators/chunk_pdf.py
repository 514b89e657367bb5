"""Page texts of PDF files into headings found by their wording, numbers or capitals."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import PurePosixPath

from treegrain.operators.outline import Heading, Outline, Row, Rows, flatten, fold

#: Words that open a heading, without accents, and their level.
LEVELS = {w: n for n, words in ((1, "title part chapter titulo parte capitulo"), (2, "section article seccion articulo disposicion"), (3, "anexo")) for w in words.split()}
_NUMERAL = re.compile(r"\s+([IVXLCDM\d]+[a-z]?)\b[\s\-:.]*(.*)$", re.IGNORECASE)
_FIRST_WORD = re.compile(r"\w+")
_NUMBER = re.compile(r"(\d+(?:\.\d+)*)\.?\s+(.+)$")
_UPPER = "A-ZÁÉÍÓÚÜÑ"
_CAPITALS = re.compile(f"[{_UPPER}][{_UPPER}0-9 ,\\-:'/]{{2,79}}$")
#: Accents that may be missing in a heading's word, as they are lost in recognition of scanned pages.
_KEPT = frozenset("íóáéú")


def classify(line: str) -> tuple[str, int, str] | None:
    """(kind, level, title) of a heading line, None for others. kind: word and allcaps have absolute levels, numbered one below what it stands under."""
    line = line.strip()
    word = _FIRST_WORD.match(line)
    if word and fold(word[0].lower()) in LEVELS and all(c < "\x80" or c in _KEPT for c in word[0].lower()):
        rest = _NUMERAL.match(line, word.end())
        if rest:
            tail = rest[2].strip()
            return "word", LEVELS[fold(word[0].lower())], f"{word[0].lower().title()} {rest[1]}" + (f" - {tail}" if tail else "")
    if numbered := _NUMBER.match(line):
        number, tail = numbered[1], numbered[2].strip()
        if not tail or tail[0].islower() or len(tail) > 120:
            return None
        return "numbered", min(max(number.count(".") + 1, 1), 4), f"{number} {tail}"
    if _CAPITALS.match(line) and len(line.split()) <= 12:
        return "allcaps", 2, line.title()
    return None


def pdf_rows(pages: list[str], source: str, *, title: str | None = None, root: str = "doc", min_chars: int = 40, page_fallback: bool = True) -> list[Row]:
    """Root and headings; pages if there are no headings (or one root with all text, without page_fallback)."""
    pages = [p or "" for p in pages]
    name = title or PurePosixPath(source).stem or "Document"
    head, rows = [root, name], Rows()
    if not any(p.strip() for p in pages):
        rows.put(root, 0, [*head, "", "[no extractable text — PDF may be scanned without OCR]"], source, 1, len(pages) or 1)
        return rows
    outline = Outline()
    for line in (x for p in pages for x in p.splitlines()):
        if found := classify(line):
            kind, level, text = found
            outline.add(Heading(level + (outline.base_level() if kind == "numbered" else 0), text, kind))
        elif outline.current is not None and line.strip():
            outline.current.body.append(line.strip())
    if not outline.top and not page_fallback:
        rows.put(root, 0, [*head, "", "\n\n".join(p.strip() for p in pages if p.strip())], source, 1, len(pages))
        return rows
    rows.put(root, 0, head, source, 1, len(pages) or 1)
    if outline.top:
        flatten(outline, rows, root=root, source=source, separator=" ", min_chars=min_chars, fold_accents=True, drop_short_leaves=True)
    else:
        for n, page in enumerate(pages, 1):
            if page.strip():
                rows.put(path := f"{root}.page{n}", 1, [path, f"Page {n}", "", page.strip()], source, n, n)
    return rows


def extractor(backend: str) -> Callable[[bytes], list[str]]:
    """bytes of a PDF file to page texts, by an installed library; ValueError for an unknown one."""
    if backend == "pypdf":

        def pages(data: bytes) -> list[str]:
            import io

            from pypdf import PdfReader

            return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]

    elif backend == "pdfplumber":

        def pages(data: bytes) -> list[str]:
            import io

            import pdfplumber

            with pdfplumber.open(io.BytesIO(data)) as f:
                return [p.extract_text() or "" for p in f.pages]

    else:
        raise ValueError(f"unknown PDF backend: {backend}")
    return pages
