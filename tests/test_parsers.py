"""Structural parsers: goldens re-derived from their rules, and closure properties."""

import pyarrow as pa
import pytest

from treegrain.operators.chunk_html import html_rows
from treegrain.operators.chunk_legal import ROOT, articles_of, chapter_of, legal_page_rows
from treegrain.operators.chunk_markdown import list_items, markdown_rows
from treegrain.operators.chunk_pdf import classify, extractor, pdf_rows
from treegrain.operators.chunk_python import python_rows
from treegrain.operators.chunk_text import chunk_text, pieces
from treegrain.operators.outline import ancestors_exist, slugify
from treegrain.plans import fixtures
from treegrain.sources import parsers

ITEM = "an item that is certainly longer than forty characters"


def paths(rows):
    return [(r.node_path, r.depth) for r in rows]


def sound(rows):
    assert [r.local_id for r in rows] == list(range(len(rows))) and not list(ancestors_exist(rows))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>nothing here</p>", [("doc", 0)]),
        ("<h1>One</h1><h2>Two</h2><h3>Three</h3>", [("doc", 0), ("doc.one", 1), ("doc.one.two", 2), ("doc.one.two.three", 3)]),
        ("<h1>One</h1><h3>Three</h3><h2>Two</h2>", [("doc", 0), ("doc.one", 1), ("doc.one.three", 2), ("doc.one.two", 2)]),
        ("<h1>A</h1><h1>A</h1>", [("doc", 0), ("doc.a", 1), ("doc.a", 1)]),
        (f"<h1>A</h1><ul><li>{ITEM}<li>", [("doc", 0), ("doc.a", 1), ("doc.a.li1", 2)]),
        (f"<h1>A</h1><ul><li>{ITEM}</li><li>short</li></ul><ol><li>{ITEM}</li></ol>", [("doc", 0), ("doc.a", 1), ("doc.a.li1", 2), ("doc.a.li3", 2)]),
        (f"<h1>A</h1><ul><li>x<ul><li>{ITEM}</li></ul></li></ul>", [("doc", 0), ("doc.a", 1), ("doc.a.li1", 2), ("doc.a.li1.li1", 3)]),
        (f"<h1>A</h1><ul><li>{ITEM}</li></ul><h2>B</h2>", [("doc", 0), ("doc.a", 1), ("doc.a.b", 2), ("doc.a.li1", 2)]),
        ("<header><h1>Kept</h1><nav><h2>Gone</h2></nav></header><aside><h2>x</h2></aside><footer><h2>y</h2></footer>", [("doc", 0), ("doc.kept", 1)]),
        ("<html><body><h1>Q</h1></body></html>" * 10, [("doc", 0)] + [("doc.q", 1)] * 10),
    ],
)
def test_html_shapes(page, want):
    rows = html_rows(page)
    assert paths(rows) == want
    sound(rows)


def test_html_texts():
    rows = html_rows("<title> My <b>page</b></title><h1>Big &amp; <i>bold</i></h1><p>one<p>two</p><script>no()</script> lost", root="site")
    assert rows[0].text in ("site\nMypage", "site\nMy <b>page</b>")  # newer tokenizers take titles as they are
    # An unclosed paragraph holds the next one, whose text is therefore said twice.
    assert rows[1].text == "site.big-bold\nBig & bold\n\none two lost\ntwo"
    assert html_rows("<h1>A</h1>", title="T")[0].text == "doc\nT" and html_rows("")[0].text == "doc\nDocument"
    assert len(html_rows(f"<h1>A</h1><ul><li>{ITEM}</li></ul>", list_items=False)) == 2
    nested = html_rows(f"<h1>A</h1><ul><li>{ITEM} <b>b</b><ol><li>{ITEM}</li></ol></li></ul>")
    assert nested[2].text == f"doc.a.li1\nA (item 1)\n\n{ITEM} b" and nested[3].text == f"doc.a.li1.li1\nA item 1 (item 1)\n\n{ITEM}"


@pytest.mark.parametrize(
    "text, want",
    [
        ("just text", [("doc", 0)]),
        ("# A\n## B\n### C", [("doc", 0), ("doc.a", 1), ("doc.a.b", 2), ("doc.a.b.c", 3)]),
        ("# A\n# B", [("doc", 0), ("doc.a", 1), ("doc.b", 1)]),
        ("Top\n===\nSub\n---", [("doc", 0), ("doc.top", 1), ("doc.top.sub", 2)]),
        (f"# A\n- {ITEM}\n- short\n1. {ITEM}", [("doc", 0), ("doc.a", 1), ("doc.a.li1", 2), ("doc.a.li3", 2)]),
        (f"# A\n- x\n    - {ITEM}", [("doc", 0), ("doc.a", 1), ("doc.a.li1", 2), ("doc.a.li1.li1", 3)]),
        ("# A\n```\n# not a heading\n```\n~~~\n```\n# nor this\n~~~\n## B", [("doc", 0), ("doc.a", 1), ("doc.a.b", 2)]),
        ("---\ntitle: x\n---\n# A", [("doc", 0), ("doc.title-x", 1), ("doc.a", 1)]),
    ],
)
def test_markdown_shapes(text, want):
    rows = markdown_rows(text)
    assert paths(rows) == want
    sound(rows)


def test_markdown_texts():
    rows = markdown_rows("lost\n# A #\nline one\n\n  line two  \n```py\n  x = 1\n\n```\n")
    assert rows[0].text == "doc\nA" and rows[0].end_line == 9
    assert rows[1].text == "doc.a\nA\n\nline one\nline two\n```py\n  x = 1\n```"
    assert markdown_rows("## only second level")[0].text == "doc\nDocument" and markdown_rows("# x", title="T")[0].text == "doc\nT"
    assert [(i.text, len(i.items)) for i in list_items(["- a", "  more", "\t- b", "- c"])] == [("a more", 1), ("c", 0)]
    assert len(markdown_rows(f"# A\n- {ITEM}", include_lists=False)) == 2


@pytest.mark.parametrize(
    "line, want",
    [*zip(
        fixtures.PDF_LINES,
        [
            ("word", 1, "Chapter 2 - Storage"), ("word", 2, "Article 14 - Keys"), ("word", 2, "Section IV - Scope"), ("word", 2, "Artículo 7 - Plazos"), ("word", 1, "Capitulo III"), ("word", 3, "Anexo II - Tablas"), ("numbered", 1, "3 Results"), ("numbered", 3, "2.1.4 Detailed findings"), None, ("numbered", 1, "2016 Annual report"),
            ("allcaps", 2, "Data Protection Officer"), None, None, None, ("word", 1, "Part mix - of things"),
        ],
    )],
)
def test_heading_lines(line, want):
    assert classify(line) == want


def test_pdf_shapes():
    rows = pdf_rows(fixtures.PDF_PAGES, "dir/manual.pdf")
    assert paths(rows) == [("doc", 0), ("doc.chapter-1-basics", 1), ("doc.chapter-1-basics.1-setup", 2), ("doc.chapter-1-basics.1-setup.1-1-power", 3), ("doc.chapter-1-basics.article-5-safety", 2), ("doc.chapter-1-basics.article-5-safety.1-batteries", 3), ("doc.chapter-1-basics.warranty-terms", 2)]
    assert rows[0].text == "doc\nmanual" and rows[1].text.endswith("\n\nThis chapter explains what the device does.")
    sound(rows)
    pages = pdf_rows(["plain words", " ", "more words"], "x.pdf")
    assert [(r.node_path, r.start_line, r.text) for r in pages[1:]] == [("doc.page1", 1, "doc.page1\nPage 1\n\nplain words"), ("doc.page3", 3, "doc.page3\nPage 3\n\nmore words")]
    (one,) = pdf_rows(["plain words", "more words"], "x.pdf", page_fallback=False)
    assert one.text == "doc\nx\n\nplain words\n\nmore words"
    (none,) = pdf_rows(["", " "], "x.pdf", title="T")
    assert "scanned" in none.text and none.end_line == 2
    assert len(pdf_rows(["Chapter 1\nChapter 2 with a rather long title of its own, so it stays"], "x")) == 2
    assert pdf_rows(["Capítulo II Ámbito\ntexto"], "x")[1].node_path == "doc.capitulo-ii-ambito"
    with pytest.raises(ValueError):
        extractor("none")


def test_python_shapes():
    rows = python_rows(fixtures.PYTHON, "shapes.round", "f.py")
    assert paths(rows) == [("shapes.round", 0), ("shapes.round.Circle", 1), ("shapes.round.Circle.__init__", 2), ("shapes.round.Circle.area", 2), ("shapes.round.Circle.Arc", 2), ("shapes.round.draw", 1)]
    assert rows[0].text == 'shapes.round\n\n"""Round shapes."""' and (rows[0].start_line, rows[0].end_line) == (1, len(fixtures.PYTHON.splitlines()))
    assert rows[1].text == "shapes.round.Circle\n\nclass Circle:\n\nAll points at one distance from a centre."
    assert rows[2].text == "shapes.round.Circle.__init__\n\ndef __init__(self, radius):\n\nself.radius = radius"
    assert "scale=1.0" in rows[3].text and rows[3].text.endswith("Area of the disc, scaled.")
    assert paths(python_rows(fixtures.PYTHON, "m", "f", max_depth=1)) == [("m", 0), ("m.Circle", 1), ("m.draw", 1)]
    assert paths(python_rows(fixtures.PYTHON, "m", "f", max_depth=3))[5] == ("m.Circle.Arc.length", 3)
    assert "self.radius = radius" not in python_rows(fixtures.PYTHON, "m", "f", include_source=False)[2].text.split("\n\n", 2)[-1].replace("def", "")
    (bad,) = python_rows("def (:", "m", "f")
    assert bad.text.startswith("[SyntaxError: ") and bad.depth == 0
    assert python_rows("import os\nx = 1\ny = 2\n", "m", "f")[0].text == "m\n\nimport os\nx = 1"


def test_legal_shapes():
    rows = legal_page_rows(fixtures.LEGAL)
    assert paths(rows) == [("gdpr", 0), ("gdpr.ch2", 1), ("gdpr.ch2.art5", 2), ("gdpr.ch2.art5.p1", 3), ("gdpr.ch4", 1), ("gdpr.ch4.art30", 2), ("gdpr.ch4.art30.p1", 3), ("gdpr.ch4.art30.p1.pa", 4)]
    assert rows[0].text == "\n".join(ROOT) and rows[1].text == "gdpr.ch2\nChapter 2 — Principles"
    assert rows[5].text.split("\n")[3:] == ["1. The controller shall keep records of what it does with the data.", "2. Short one."]
    assert rows[7].text.split("\n")[1] == "Art. 30 Records of processing §1(a)" and rows[7].start_line == 30
    sound(rows)
    single = articles_of("<article><h1>Article 99</h1><p>Entry into force of the regulation.</p><div class='empfehlung-erwaegungsgruende'>Recital</div></article>")
    assert [(a.n, a.paragraphs[0].text) for a in single] == [(99, "Article 99 Entry into force of the regulation.")]
    assert articles_of("<p>none</p>") == [] and chapter_of(100) is None and chapter_of(1) == (1, "general_provisions") and chapter_of(93)[0] == 10
    long = "<h1>Art. 6</h1><div class='entry-content'><ol>" + f"<li>{'x' * 500}</li>" * 4 + "</ol></div>"
    assert legal_page_rows(long)[2].text.count("\n") == 4


def test_slugs():
    assert [slugify(x) for x in ("Hello, World!", "--", "é", "A" * 40, "a" * 31 + " b")] == ["hello-world", "section", "section", "a" * 32, "a" * 31]
    assert slugify("Artículo 7 É", fold_accents=True) == "articulo-7-e"


def test_table_functions(spark, small):
    parsers.register(spark)
    spark.createDataFrame([(1, "# A\ntext"), (2, "none")], "id long, t string").createOrReplaceTempView("md")
    rows = spark.sql("SELECT id, c.node_path, c.depth FROM md, LATERAL chunk_markdown(t) c ORDER BY id, c.local_id").collect()
    assert [tuple(r) for r in rows] == [(1, "doc", 0), (1, "doc.a", 1), (2, "doc", 0)]
    pages = parsers.chunk_html(spark.read.parquet(f"{small}/pages.parquet"), key="page_id")
    broken = pages.alias("c").join(pages.alias("p"), ["doc_id"]).where("p.node_path = c.parent_path").count()
    assert broken == pages.where("parent_path <> ''").count() > 0
    assert parsers.chunk_html(spark.createDataFrame([(1, None)], "doc_id long, html string")).count() == 1


def _stage(monkeypatch, docs, make):
    """The function that a plan hands to mapInArrow."""
    kept = []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, shape, *a: kept.append(f) or real(df, f, shape, *a))
    make(docs)
    return kept[0]


def test_a_batch_of_texts_is_cut_a_megabyte_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "x")], "doc_id long, text string")
    stage = _stage(monkeypatch, docs, chunk_text)
    texts = ["One sentence of a paragraph. " * 150] * 3000 + [None, ""]
    out = list(stage(iter([pa.RecordBatch.from_arrays([pa.array(range(3002)), pa.array(texts)], names=["doc_id", "__text"])])))
    assert max(b.nbytes for b in out) < 4 << 20 and sum(b.num_rows for b in out) == sum(1 + len(pieces(t)) for t in texts)


def test_parsed_rows_leave_a_megabyte_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "x")], "doc_id long, html string")
    stage = _stage(monkeypatch, docs, parsers.chunk_html)
    page = "<h1>Title</h1><p>" + "words " * 15_000 + "</p>"
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.nulls(200, pa.string()), pa.array([page] * 200)], names=["doc_id", "__named", "html"])
    out = list(stage(iter([batch])))
    assert max(b.nbytes for b in out) < 2 << 20 and sum(b.num_rows for b in out) == 400
