"""Chunking, scalar and summary queries over the driver's tables, with the SQL they are compared to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from treegrain.functions import text as T
from treegrain.functions.vectors import letter_counts
from treegrain.operators import summaries
from treegrain.operators.chunk_legal import CHAPTERS, LAST_ARTICLE
from treegrain.operators.chunk_pdf import classify
from treegrain.operators.chunk_text import chunk_text
from treegrain.operators.chunks import depth_histogram
from treegrain.plans import fixtures
from treegrain.session import table
from treegrain.sources import parsers, readers


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut into paragraphs."""
    return chunk_text(table(spark, sf_dir, "documents")).select("doc_id", F.col("local_id").cast("long").alias("local_id"), "depth", "node_path", "parent_path", "text")


def text_chunk_depth_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth_histogram(chunk_text(table(spark, sf_dir, "documents")))


def html_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages cut at their headings."""
    return parsers.chunk_html(table(spark, sf_dir, "pages"), key="page_id", source="url")


def html_depth_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return depth_histogram(html_chunks(spark, sf_dir))


def fetched_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages sent to the parser that their address and content ask for."""
    return readers.fetched_pages(table(spark, sf_dir, "pages"))


def sniff_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("s"))
    p = table(spark, sf_dir, "pages")
    rows = d.unionByName(p.select(F.lit("html").alias("origin"), F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).alias("s"))).unionByName(p.select(F.lit("url").alias("origin"), F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("s")))
    return rows.select("origin", "id", readers.sniff_kind(F.col("s")).alias("kind"))


def slugify_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("slug"))


def path_parent_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", F.lower("p_type"), T.slug(F.col("p_brand")), T.slug(F.col("p_name"))).alias("node_path"))
    return p.select("p_partkey", "node_path", T.parent_path(F.col("node_path")).alias("parent_path"), T.path_name(F.col("node_path")).alias("name"))


def encode_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = letter_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[v[i].cast("long").alias(f"n_{c}") for i, c in enumerate("abcdefgh")])


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc.d"), F.col("doc_id").cast("string")).alias("node_path"), F.coalesce("text", F.lit("")).alias("text"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the labelled documents: their quality."""
    labelled = _chunks(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return labelled.select(T.chunk_key(F.col("node_path"), F.col("text")).alias("key"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("summary"))


def chunk_key_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", T.chunk_key(F.col("node_path"), F.col("text")).alias("key"))


def summary_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.todo(_chunks(spark, sf_dir), _cache(spark, sf_dir)).select("doc_id", "key")


def summary_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.apply(_chunks(spark, sf_dir), _cache(spark, sf_dir)).select("doc_id", "text")


def chapter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and their chapters, by a range join with eleven rows."""
    ends = [first for first, _ in CHAPTERS[1:]] + [LAST_ARTICLE + 1]
    chapters = spark.createDataFrame([(a, b - 1, n, name) for n, ((a, name), b) in enumerate(zip(CHAPTERS, ends), 1)], "lo long, hi long, chapter int, name string")
    articles = spark.range(1, 120).withColumnRenamed("id", "article")
    return articles.join(F.broadcast(chapters), (articles.article >= chapters.lo) & (articles.article <= chapters.hi)).select("article", "chapter", T.chapter_title(F.col("name")).alias("title"))


_LEVELS = [1, 2, 3, 2, 3, 3, 1, 4, 2, 6, 3, 1, 2, 5, 5, 2]


def heading_tree_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and depth of headings from their levels, with windows only: the nearest heading before that has a smaller level."""
    rows = spark.createDataFrame([(1, i, level) for i, level in enumerate(_LEVELS)] + [(2, i, level) for i, level in enumerate(reversed(_LEVELS))], "doc long, i long, level int")
    before = W.partitionBy("doc").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    for n in range(1, 7):
        rows = rows.withColumn(f"l{n}", F.last(F.when(F.col("level") == n, F.col("i")), ignorenulls=True).over(before))
    at = lambda n, level: F.when(F.lit(n) < level, F.coalesce(F.col(f"l{n}"), F.lit(-1))).otherwise(-1)
    parent = F.greatest(*[at(n, F.col("level")) for n in range(1, 7)])
    on_chain = lambda n: (at(n, F.col("level")) >= 0) & (at(n, F.col("level")) > F.greatest(F.lit(-1), F.lit(-2), *[F.coalesce(F.col(f"l{m}"), F.lit(-1)) for m in range(1, n)]))
    depth = sum((F.when(on_chain(n), 1).otherwise(0) for n in range(1, 7)), F.lit(1))
    return rows.select("doc", "i", "level", F.when(parent >= 0, parent).alias("parent"), depth.cast("int").alias("depth"))


def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading lines of page texts."""
    from treegrain.session import ship_code

    ship_code(spark)
    rows = spark.createDataFrame(list(enumerate(fixtures.PDF_LINES)), "i long, line string")

    def each(s):
        import pandas as pd

        found = [classify(x) or (None, None, None) for x in s]
        return pd.DataFrame(found, columns=["kind", "level", "title"]).astype({"level": "Int32"})

    return rows.withColumn("c", F.pandas_udf(each, "kind string, level int, title string")("line")).select("i", "line", "c.*")


def md_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.chunk_markdown(spark.createDataFrame([(0, fixtures.MARKDOWN)], "doc_id long, text string"))


def pdf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.chunk_pdf(spark.createDataFrame([(0, fixtures.PDF_PAGES, "manual.pdf")], "doc_id long, pages array<string>, source string"))


def ast_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.chunk_python(spark.createDataFrame([(0, fixtures.PYTHON, "shapes.round", "shapes/round.py")], "doc_id long, text string, module string, source string"))


def legal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.chunk_legal(spark.createDataFrame([(0, fixtures.LEGAL)], "doc_id long, html string"))


QUERIES = {
    f.__name__: f
    for f in (
        text_chunks, text_chunk_depth_hist, html_chunks, html_depth_hist, fetched_page_chunks, sniff_kind, slugify_titles, path_parent_name, encode_letters, chunk_key_sha, summary_todo, summary_apply,
        chapter_lookup, heading_tree_window, line_classify, md_chunks, pdf_chunks, ast_chunks, legal_chunks,
    )
}

_SENTENCES = r"""stripped AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS p FROM documents),
cut AS (SELECT doc_id, CASE WHEN length(p) <= 1200 THEN [p] ELSE string_split(regexp_replace(p, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS parts FROM stripped WHERE p <> ''),
fold AS (SELECT doc_id, parts, 1 AS i, 1 AS chunk, length(parts[1]) AS used, parts[1] AS sentence FROM cut
  UNION ALL SELECT doc_id, parts, i + 1, CASE WHEN used + length(parts[i + 1]) + 1 > 1200 THEN chunk + 1 ELSE chunk END, CASE WHEN used + length(parts[i + 1]) + 1 > 1200 THEN length(parts[i + 1]) ELSE used + 1 + length(parts[i + 1]) END, parts[i + 1] FROM fold WHERE i < len(parts)),
pieces AS (SELECT doc_id, chunk, string_agg(sentence, ' ' ORDER BY i) AS piece FROM fold GROUP BY doc_id, chunk),
chunks AS (SELECT doc_id, 0::BIGINT AS local_id, 0 AS depth, 'doc' AS node_path, '' AS parent_path, 'doc' || chr(10) || 'Document' AS text FROM documents
  UNION ALL SELECT doc_id, chunk, 1, 'doc.p' || chunk, 'doc', 'doc.p' || chunk || chr(10) || 'Document (paragraph ' || chunk || ')' || chr(10) || chr(10) || piece FROM pieces)"""
_HTML = r"(?i)<(html|body|head|h[1-6]|div|article|section|main)\b"
_KIND = rf"CASE WHEN regexp_matches(s, '(?i)^https?://') THEN 'url' WHEN regexp_matches(substr(s, 1, 1024), '{_HTML}') THEN 'html' WHEN regexp_matches(substr(s, 1, 1024), '(?m)^\s{{0,3}}#{{1,6}}\s+\S') THEN 'markdown' ELSE 'text' END"
_SLUG = lambda x: f"rtrim(coalesce(nullif(substr(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 32), ''), 'section'), '-')"
_KEY = "substr(sha256('doc.d' || doc_id || '|' || text), 1, 16)"
_ENDS = [first for first, _ in CHAPTERS[1:]] + [LAST_ARTICLE + 1]
_CHAPTERS = ", ".join(f"({a}, {b - 1}, {n}, '{' '.join(w.capitalize() for w in name.split('_'))}')" for n, ((a, name), b) in enumerate(zip(CHAPTERS, _ENDS), 1))
_HEADINGS = ", ".join(f"({d}::BIGINT, {i}::BIGINT, {level})" for d, levels in ((1, _LEVELS), (2, _LEVELS[::-1])) for i, level in enumerate(levels))
ORACLE_SQL = {
    "text_chunks": f"WITH RECURSIVE {_SENTENCES} SELECT * FROM chunks",
    "text_chunk_depth_hist": f"WITH RECURSIVE {_SENTENCES} SELECT depth, count(*) AS n_chunks FROM chunks GROUP BY depth",
    "html_depth_hist": "SELECT 0 AS depth, count(*) AS n_chunks FROM pages UNION ALL SELECT 1, sum(len(regexp_extract_all(html, '(?i)<h1[ >]')))::BIGINT FROM pages",
    "sniff_kind": f"SELECT origin, id, {_KIND} AS kind FROM (SELECT 'document' AS origin, doc_id AS id, text AS s FROM documents UNION ALL SELECT 'html', page_id, html FROM pages UNION ALL SELECT 'url', page_id, url FROM pages)",
    "slugify_titles": f"SELECT p_partkey, {_SLUG("p_name || ' ' || p_brand || ' ' || p_type")} AS slug FROM part",
    "path_parent_name": f"WITH p AS (SELECT p_partkey, lower(p_type) || '.' || {_SLUG('p_brand')} || '.' || {_SLUG('p_name')} AS node_path FROM part) SELECT p_partkey, node_path, regexp_replace(node_path, '\\.[^.]*$', '') AS parent_path, regexp_extract(node_path, '[^.]*$') AS name FROM p",
    "encode_letters": "SELECT doc_id, " + ", ".join(f"length(lower(text)) - length(replace(lower(text), '{c}', '')) AS n_{c}" for c in "abcdefgh") + " FROM documents",
    "chunk_key_sha": f"SELECT doc_id, {_KEY} AS key FROM documents",
    "summary_todo": f"SELECT doc_id, {_KEY} AS key FROM documents WHERE {_KEY} NOT IN (SELECT {_KEY} FROM documents JOIN labels USING (doc_id))",
    "summary_apply": "SELECT doc_id, CASE WHEN quality IS NULL THEN text ELSE 'doc.d' || doc_id || chr(10) || 'quality ' || quality END AS text FROM documents LEFT JOIN labels USING (doc_id)",
    "chapter_lookup": f"SELECT range AS article, chapter, title FROM range(1, 120), (VALUES {_CHAPTERS}) c(lo, hi, chapter, title) WHERE range BETWEEN lo AND hi",
    "heading_tree_window": f"""WITH RECURSIVE h(doc, i, level) AS (VALUES {_HEADINGS}), p AS (SELECT *, (SELECT max(b.i) FROM h b WHERE b.doc = a.doc AND b.i < a.i AND b.level < a.level) AS parent FROM h a),
t AS (SELECT doc, i, 1 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.doc, p.i, t.depth + 1 FROM p JOIN t ON p.doc = t.doc AND p.parent = t.i) SELECT p.doc, p.i, p.level, p.parent, t.depth FROM p JOIN t USING (doc, i)""",
}
