"""Ingest queries over the driver's tables, with the SQL they are compared to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from treegrain.operators.chunks import append, number
from treegrain.session import table


def number_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four copies of every line item, numbered through in order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array(*map(F.lit, range(4)))).alias("copy"))
    return number(rows, ["l_orderkey", "l_linenumber", "copy"])


def append_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, then pages after them."""
    flat = lambda name, key, prefix: table(spark, sf_dir, name).where(F.col(key).isNotNull()).select(F.lit("").alias("text"), F.lit(0).alias("depth"), F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 12, "0")).alias("node_path"), F.lit(name).alias("source_file"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    return append(append(None, flat("documents", "doc_id", "d."), ["node_path"]), flat("pages", "page_id", "p."), ["node_path"]).select("id", "pos", "node_path", "parent_path", "name")


QUERIES = {f.__name__: f for f in (number_documents, append_chunks)}
ORACLE_SQL = {
    "number_documents": "SELECT l_orderkey, l_linenumber, copy::INTEGER AS copy, row_number() OVER (ORDER BY l_orderkey, l_linenumber, copy) - 1 AS pos FROM lineitem, range(4) c(copy)",
    "append_chunks": """WITH named AS (SELECT 0 AS part, 'd.' AS parent, lpad(doc_id::VARCHAR, 12, '0') AS name FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 1, 'p.', lpad(page_id::VARCHAR, 12, '0') FROM pages WHERE page_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (ORDER BY part, name) - 1 AS pos FROM named) SELECT pos AS id, pos, parent || name AS node_path, rtrim(parent, '.') AS parent_path, name FROM placed""",
}
