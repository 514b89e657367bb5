"""Sources: what a string is, tables of fetched pages, files, directories, archives and JSON documents, all as DataFrames."""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treegrain.functions.text import module_name
from treegrain.operators.chunk_text import chunk_text
from treegrain.operators.chunks import append, number, text_list
from treegrain.session import ship_code
from treegrain.sources import parsers

SUFFIXES = {"html": "html", "htm": "html", "xhtml": "html", "md": "markdown", "markdown": "markdown", "pdf": "pdf", "py": "python", "txt": "text", "rst": "text"}
_TAGS = r"(?i)<(html|body|head|h[1-6]|div|article|section|main)\b"
_COLUMNS = ["doc_id", "local_id", "text", "depth", "node_path", "parent_path", "name", "source_file", "start_line", "end_line"]


def sniff_kind(text: Column, *, exists: Column | None = None) -> Column:
    """url, path, html, markdown or text. A path is what `exists` says of strings that could be one; without it none is (an empty string is text)."""
    head = F.substring(text, 1, 1024)
    kind = F.when(text.rlike(r"(?i)\Ahttps?://"), "url")
    if exists is not None:
        likely = (text != "") & ~F.contains(text, F.lit("\n")) & (F.length(text) < 260) & ~text.rlike(r"\A\s*[<#]")
        kind = kind.when(likely & exists, "path")
    return kind.when(head.rlike(_TAGS), "html").when(head.rlike(r"(?m)^\s{0,3}#{1,6}\s+\S"), "markdown").otherwise("text")


def fetched_kind(url: Column, content_type: Column, body: Column) -> Column:
    """What a fetched page is: PDF and Markdown by type or suffix, plain text unless it looks like HTML, else HTML."""
    kind, path = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return (
        F.when(F.contains(kind, F.lit("application/pdf")) | F.endswith(path, F.lit(".pdf")), "pdf")
        .when(F.contains(kind, F.lit("markdown")) | path.rlike(r"\.(md|markdown)$"), "markdown")
        .when(F.contains(kind, F.lit("text/plain")) & ~F.substring(body, 1, 1024).rlike(_TAGS), "text")
        .otherwise("html")
    )


def suffix_kind(path: Column) -> Column:
    """Kind of a file by its suffix, text for any other."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = reduce(lambda w, s: w.when(suffix == s, SUFFIXES[s]), list(SUFFIXES)[1:], F.when(suffix == "html", "html"))
    return known.otherwise("text")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/?$", 1), r"(?<=.)\.[^.]*$", "")


def dispatch(docs: DataFrame, *, options: dict[str, dict] | None = None) -> DataFrame:
    """Chunk rows of a mixed table (doc_id, kind, content, optionally title, source, module): each kind goes to its parser, with that kind's options only.

    Kinds: text, html, markdown, python, legal, pdf (content: pages joined by form feeds). Rows of other kinds are an error.
    """
    options = options or {}
    have = set(docs.columns)
    col = lambda name, default: F.col(name) if name in have else F.lit(default).cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "kind", "content", col("title", None).alias("title"), col("source", None).alias("source"), col("module", "module").alias("module"))
    known = ["text", "html", "markdown", "python", "legal", "pdf"]
    base = base.withColumn("kind", F.when(F.col("kind").isin(*known), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no parser for kind "), F.coalesce("kind", F.lit("null"))))))
    of = lambda k: base.where(F.col("kind") == k)
    parts = [
        chunk_text(of("text"), text="content", title="title", **options.get("text", {})).withColumn("local_id", F.col("local_id").cast("long")),
        parsers.chunk_html(of("html"), html="content", source="source", **options.get("html", {})),
        parsers.chunk_markdown(of("markdown"), text="content", source="source", **options.get("markdown", {})),
        parsers.chunk_python(of("python"), text="content", **options.get("python", {})),
        parsers.chunk_legal(of("legal"), html="content", **options.get("legal", {})),
        parsers.chunk_pdf(of("pdf").withColumn("pages", F.split("content", "\f")), **options.get("pdf", {})),
    ]
    return reduce(DataFrame.unionByName, [p.select(*_COLUMNS) for p in parts])


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for b in batches:
        for path, relative in zip(b["path"], b["relative"]):
            store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
            with store.open_input_stream(name) as f:
                yield pd.DataFrame({"path": [path], "relative": [relative], "content": [f.read()]})


def files(spark: SparkSession, path: str, *, suffixes: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, relative, content) of the supported files below a directory; directories named in `exclude` are left out wherever they are.

    Spark's own file source passes over names that begin with an underscore, such as a package's __init__.py; so names are listed by the
    file system's client, and contents are read in the executors, one file at a time.
    """
    wanted = set(suffixes or SUFFIXES)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = store.makeQualified(root).toString().rstrip("/") + "/"
    found, listing = [], store.listFiles(root, True)
    while listing.hasNext():
        name = listing.next().getPath().toString()
        relative = name[len(base) :]
        if relative.rpartition(".")[2].lower() in wanted and "." in relative and not set(relative.split("/")[:-1]) & set(exclude):
            found.append((name, relative))
    ship_code(spark)
    rows = spark.createDataFrame(found, "path string, relative string") if found else spark.createDataFrame([], "path string, relative string")
    parts = max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))
    return rows.repartition(parts).mapInPandas(_read_files, "path string, relative string, content binary")


def directory(spark: SparkSession, path: str, *, qualified: bool = True, options: dict[str, dict] | None = None, exclude: tuple[str, ...] = (), pages=None) -> DataFrame:
    """Chunks of a directory's files in path order, numbered through. Python modules have dotted names relative to the directory, or file stems (qualified=False)."""
    found = files(spark, path, exclude=exclude)
    # By the path's parts, as a recursive walk sorts them.
    found = number(found.select("path", "relative", F.split("relative", "/").alias("__parts")), ["__parts"], column="doc_id").drop("__parts", "relative").join(found, "path")
    return _chunks_of_files(found, qualified=qualified, options=options, pages=pages)


def _chunks_of_files(found: DataFrame, *, qualified: bool, options: dict[str, dict] | None, pages=None) -> DataFrame:
    name = module_name(F.col("relative")) if qualified else stem(F.col("relative"))
    rows = found.withColumn("kind", suffix_kind(F.col("relative")))
    text = F.decode("content", "UTF-8")
    plain = rows.where("kind != 'pdf'").select("doc_id", "kind", text.alias("content"), stem(F.col("relative")).alias("title"), F.col("path").alias("source"), name.alias("module"))
    if pages is not None:
        pdf = parsers.extract_pages(rows.where("kind = 'pdf'"), pages=pages)
        plain = plain.unionByName(pdf.select("doc_id", "kind", F.array_join("pages", "\f").alias("content"), stem(F.col("relative")).alias("title"), F.col("path").alias("source"), name.alias("module")))
    chunks = dispatch(plain, options=options)
    return append(None, chunks, ["doc_id", "local_id"])


def fetched_pages(pages: DataFrame, *, options: dict[str, dict] | None = None) -> DataFrame:
    """Chunks of fetched pages (page_id, url, html, optionally content_type); the engine itself fetches nothing."""
    kind = F.col("content_type") if "content_type" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").alias("doc_id"), fetched_kind(F.col("url"), kind, F.col("html")).alias("kind"), F.col("html").alias("content"), F.col("url").alias("title"), F.col("url").alias("source"))
    return dispatch(rows, options=options)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Chunks given as JSON rows {text, node_path, depth?, source_file?}."""
    rows = spark.read.schema("text string, node_path string, depth int, source_file string").json(path)
    return given_chunks(rows)


def given_chunks(rows: DataFrame) -> DataFrame:
    """Ready chunks with defaults for what they leave out; text and node_path are required."""
    for c in ("text", "node_path"):
        if c not in rows.columns:
            raise ValueError(f"column {c} is missing")
    have = set(rows.columns)
    full = rows.select("text", "node_path", (F.coalesce(F.col("depth"), F.lit(0)) if "depth" in have else F.lit(0)).cast("int").alias("depth"), (F.coalesce(F.col("source_file"), F.lit("<inline>")) if "source_file" in have else F.lit("<inline>")).alias("source_file"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    return append(None, full, ["node_path", "text"])


def archive_members(data: bytes, kind: str) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the files in a zip or tar.gz archive, in memory; ValueError for a member that would lie outside, or an unknown kind."""

    def inside(name: str) -> str:
        path = posixpath.normpath(name.replace("\\", "/"))
        if path.startswith(("/", "../")) or path == ".." or re.match(r"[A-Za-z]:", path):
            raise ValueError(f"unsafe path in archive: {name}")
        return path

    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                path = inside(info.filename)
                if not info.is_dir():
                    yield path, z.read(info)
    elif kind == "tar.gz":
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as t:
            for member in t:
                path = inside(member.name)
                if member.isfile():
                    yield path, t.extractfile(member).read()
    else:
        raise ValueError(f"unknown kind of archive: {kind}")


def archives(uploads: DataFrame, *, max_bytes: int) -> DataFrame:
    """(archive_id, path, content) of base64 archives (archive_id, archive_b64, archive_format); one over max_bytes is an error."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, data, kind in zip(b["archive_id"], b["data"], b["archive_format"]):
                if len(data) > max_bytes:
                    raise ValueError(f"archive {i} has {len(data)} bytes, {max_bytes} are allowed")
                rows = list(archive_members(bytes(data), kind))
                yield pd.DataFrame({"archive_id": i, "path": [p for p, _ in rows], "content": [c for _, c in rows]})

    return uploads.select("archive_id", F.unbase64("archive_b64").alias("data"), "archive_format").mapInPandas(each, "archive_id long, path string, content binary")


def index_archive(uploads: DataFrame, *, max_bytes: int, options: dict[str, dict] | None = None) -> DataFrame:
    """Chunks of the files in archives, in order of archive and path."""
    members = archives(uploads, max_bytes=max_bytes).withColumn("relative", F.col("path"))
    kept = members.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    numbered = number(kept.select("archive_id", "path"), ["archive_id", "path"], column="doc_id").join(kept, ["archive_id", "path"])
    return _chunks_of_files(numbered, qualified=True, options=options)


def chunks_from_source(spark: SparkSession, source, *, options: dict[str, dict] | None = None) -> DataFrame:
    """Chunks of a list of texts, a path, or a string of any kind; TypeError for anything else. URLs have to be fetched outside: see fetched_pages()."""
    import os
    from pathlib import Path

    if isinstance(source, (list, tuple)):
        return text_list(spark.createDataFrame(list(enumerate(source)), "i long, text string"))
    if isinstance(source, Path):
        kind = "path"
    elif not isinstance(source, str):
        raise TypeError(f"can't read chunks from {type(source).__name__}")
    else:
        could = source and "\n" not in source and len(source) < 260 and not source.lstrip().startswith(("<", "#"))
        kind = "path" if could and os.path.exists(os.path.expanduser(source)) else spark.range(1).select(sniff_kind(F.lit(source))).first()[0]
    if kind == "url":
        raise ValueError("the engine fetches nothing; pass a table of fetched pages to fetched_pages()")
    if kind == "path":
        path = str(Path(source).expanduser().resolve())
        if os.path.isdir(path):
            return directory(spark, path, options=options)
        one = spark.read.format("binaryFile").load(path).select(F.lit(0).cast("long").alias("doc_id"), "path", F.lit(os.path.basename(path)).alias("relative"), "content")
        return _chunks_of_files(one, qualified=False, options=options)
    one = spark.createDataFrame([(0, kind, source)], "doc_id long, kind string, content string")
    return append(None, dispatch(one, options=options), ["doc_id", "local_id"])
