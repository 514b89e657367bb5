"""Structural parsers as table functions over columns: one document row in, its chunk rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from treegrain.functions.text import parent_path, path_name
from treegrain.operators.chunk_html import html_rows
from treegrain.operators.chunk_legal import legal_page_rows
from treegrain.operators.chunk_markdown import markdown_rows
from treegrain.operators.chunk_pdf import extractor, pdf_rows
from treegrain.operators.chunk_python import python_rows
from treegrain.operators.outline import Row
from treegrain.session import ship_code, spread, tidy

PARSED = "doc_id long, local_id long, text string, depth int, node_path string, source_file string, start_line int, end_line int"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
_NAMES = [x.split()[0] for x in PARSED.split(", ")]
#: Rows of parsed chunks that one Arrow batch holds at most, and characters after which it is given away.
BATCH_ROWS, BATCH_CHARS = 2000, 1 << 20


def run_parser(docs: DataFrame, parse: Callable[..., list[Row]], columns: list[str], *, key: str = "doc_id", source: str | None = None) -> DataFrame:
    """Apply parse(*columns) to every row; no shuffle. Columns: doc_id, local_id, text, depth, node_path, parent_path, name, source_file, start_line, end_line.

    `source`, a column, replaces the parsers' own name of the source. Documents are taken from their batch one by one and rows
    are written out as they come, so only the size of a document and that of Spark's own batch matter, not that of a partition.
    """
    ship_code(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), _KINDS)], names=_NAMES)
        for b in batches:
            for i in range(b.num_rows):
                doc, named, *args = (c[i].as_py() for c in b.columns)
                for r in parse(*args):
                    out.append((doc, r.local_id, r.text, r.depth, r.node_path, named or r.source_file, r.start_line, r.end_line))
                    size += len(r.text) + len(r.node_path)
                    if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield pack()
                        out, size = [], 0
        if out:
            yield pack()

    needed = docs.select(F.col(key).cast("long"), (F.col(source) if source else F.lit(None)).cast("string").alias("__named"), *columns)
    rows = spread(needed).mapInArrow(tidy(each), PARSED)
    return rows.withColumn("parent_path", parent_path(F.col("node_path"))).withColumn("name", path_name(F.col("node_path")))


def chunk_html(docs: DataFrame, *, key: str = "doc_id", html: str = "html", source: str | None = None, **options) -> DataFrame:
    return run_parser(docs, lambda page: html_rows(page or "", **options), [html], key=key, source=source)


def chunk_markdown(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str | None = None, **options) -> DataFrame:
    return run_parser(docs, lambda t: markdown_rows(t or "", **options), [text], key=key, source=source)


def chunk_pdf(docs: DataFrame, *, key: str = "doc_id", pages: str = "pages", source: str = "source", **options) -> DataFrame:
    """docs have page texts (array of strings); extract_pages() makes them from files."""
    return run_parser(docs, lambda p, s: pdf_rows(list(p or []), s or "", **options), [pages, source], key=key)


def chunk_python(docs: DataFrame, *, key: str = "doc_id", text: str = "text", module: str = "module", source: str = "source", **options) -> DataFrame:
    return run_parser(docs, lambda t, m, s: python_rows(t or "", m, s, **options), [text, module, source], key=key)


def chunk_legal(docs: DataFrame, *, key: str = "doc_id", html: str = "html", **options) -> DataFrame:
    return run_parser(docs, lambda page: legal_page_rows(page or "", **options), [html], key=key)


def extract_pages(files: DataFrame, *, backend: str = "pypdf", content: str = "content", pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """files with a column `pages` of page texts, by an installed PDF library or a function of one's own."""
    read = pages or extractor(backend)
    ship_code(files.sparkSession)

    def each(s):
        import pandas as pd

        return pd.Series([read(bytes(b)) if b is not None else [] for b in s])

    return files.withColumn("pages", F.pandas_udf(each, "array<string>")(F.col(content)))


def register(spark: SparkSession) -> None:
    """Make chunk_html, chunk_markdown, chunk_pdf, chunk_python and chunk_legal known to SQL, to be used with LATERAL."""
    from pyspark.sql.functions import udtf

    ship_code(spark)
    shape = "local_id int, text string, depth int, node_path string, source_file string, start_line int, end_line int"

    def table_function(parse: Callable[..., list[Row]]):
        class Chunks:
            def eval(self, *args):
                for r in parse(*args):
                    yield r.local_id, r.text, r.depth, r.node_path, r.source_file, r.start_line, r.end_line

        return udtf(Chunks, returnType=shape)

    for name, parse in {
        "chunk_html": lambda page: html_rows(page or ""),
        "chunk_markdown": lambda t: markdown_rows(t or ""),
        "chunk_pdf": lambda pages, source: pdf_rows(list(pages or []), source or ""),
        "chunk_python": lambda t, module, source: python_rows(t or "", module, source),
        "chunk_legal": lambda page: legal_page_rows(page or ""),
    }.items():
        spark.udtf.register(name, table_function(parse))
