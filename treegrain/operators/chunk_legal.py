"""Pages of the General Data Protection Regulation into chapters, articles, paragraphs and points."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from treegrain.operators.dom import Element, parse
from treegrain.operators.outline import Row, Rows

#: First article of each chapter, and its name; the last article is 99.
CHAPTERS = [
    (1, "general_provisions"),
    (5, "principles"),
    (12, "rights_data_subject"),
    (24, "controller_processor"),
    (44, "third_country_transfers"),
    (51, "supervisory_authorities"),
    (60, "cooperation_consistency"),
    (77, "remedies_liability"),
    (85, "specific_situations"),
    (92, "delegated_acts"),
    (94, "final_provisions"),
]
LAST_ARTICLE = 99
ROOT = [
    "gdpr",
    "REGULATION (EU) 2016/679 — General Data Protection Regulation",
    "",
    " ".join(["EU regulation on the protection of natural persons with", "regard to the processing of personal data and on", "the free movement of such data."]),
]
_NUMBER = re.compile(r"\bart(?:icle|\.)?\s*(\d+)\b", re.IGNORECASE)
_SITE = "gdpr-info.eu"


@dataclass
class Paragraph:
    n: int
    text: str
    points: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Article:
    n: int
    title: str
    paragraphs: list[Paragraph]
    source: str = "<inline>"


def chapter_of(article: int) -> tuple[int, str] | None:
    """Number and name of an article's chapter, None outside the regulation."""
    if not 1 <= article <= LAST_ARTICLE:
        return None
    return max((k, name) for k, (first, name) in enumerate(CHAPTERS, 1) if first <= article)


def _number(heading: Element | None) -> int | None:
    m = _NUMBER.search(heading.raw_text()) if heading else None
    return int(m[1]) if m else None


def _paragraphs(body: Element) -> list[Paragraph]:
    listed = body.first("ol")
    if listed is None:
        text = body.text()
        return [Paragraph(1, text)] if text else []
    out = []
    for n, li in enumerate(listed.direct("li"), 1):
        nested = li.first("ol")
        points = [(chr(97 + k), t) for k, x in enumerate(nested.direct("li")) if (t := x.text())] if nested else []
        li.remove(lambda e: e.tag == "ol")
        if text := li.text():
            out.append(Paragraph(n, text, points))
    return out


def articles_of(page: str) -> list[Article]:
    """Articles of one page or several pages in a row: bodies of class entry-content, each under the heading before it."""
    tree = parse(page)
    bodies, heading, found = [], None, False
    for e in tree.walk():
        if e.tag in ("h1", "h2"):
            heading = e
        elif e.tag == "div" and e.has_class("entry-content"):
            found = True
            bodies.append((heading, e))
    if not found:
        tree.remove(lambda e: e.tag == "div" and e.has_class("empfehlung-erwaegungsgruende"))
        body = tree.first("article")
        bodies = [(tree.first("h1", "h2"), body)] if body else []
    return [Article(n, h.text(""), _paragraphs(b)) for h, b in bodies if (n := _number(h)) is not None]


def _article_text(path: str, article: Article, most: int = 1200) -> list[str]:
    lines, used = [path, article.title, ""], len(path) + len(article.title)
    for k, p in enumerate(article.paragraphs):
        line = f"{p.n}. {p.text}"
        if k and used + len(line) > most:
            break
        lines.append(line)
        used += len(line) + 1
    return lines


def legal_rows(articles: list[Article], *, min_paragraph: int = 40, min_point: int = 40) -> list[Row]:
    """Regulation, chapters before their first article, articles by number, paragraphs with their points (short ones left out, with theirs)."""
    rows = Rows()
    rows.put("gdpr", 0, ROOT, _SITE)
    seen = set()
    for a in sorted(articles, key=lambda x: x.n):
        chapter = chapter_of(a.n)
        if chapter is None:
            continue
        at = f"gdpr.ch{chapter[0]}"
        if chapter not in seen:
            seen.add(chapter)
            rows.put(at, 1, [at, f"Chapter {chapter[0]} — {chapter[1].replace('_', ' ').title()}"], _SITE, a.n, a.n)
        path = f"{at}.art{a.n}"
        rows.put(path, 2, _article_text(path, a), a.source, a.n, a.n)
        for p in a.paragraphs:
            if len(p.text) < min_paragraph:
                continue
            own = f"{path}.p{p.n}"
            rows.put(own, 3, [own, f"{a.title}, paragraph {p.n}", "", p.text], a.source, a.n, a.n)
            for letter, text in p.points:
                if len(text) >= min_point:
                    rows.put(point := f"{own}.p{letter}", 4, [point, f"{a.title} §{p.n}({letter})", "", text], a.source, a.n, a.n)
    return rows


def legal_page_rows(page: str, **options) -> list[Row]:
    return legal_rows(articles_of(page), **options)
