"""Structural expansion: the parents, children and siblings of each query's seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Seeds that are broadcast to the corpus's side at most; beyond, the joins shuffle by path.
SEED_ROWS = 50_000


def first_rows(corpus: DataFrame, path: str, wanted: DataFrame, most: int, key: list[str]) -> DataFrame:
    """Of the rows under each wanted path, the `most` first by position: what any query can show of them, however many there are.

    The literal bound lets Spark cut each path's rows in the tasks that read them, before they are shuffled.
    """
    kept = corpus.withColumnRenamed(path, "path").join(wanted, ["path", *key], "left_semi").withColumn("__n", F.row_number().over(W.partitionBy("path", *key).orderBy("pos", "id")))
    return kept.where(F.col("__n") <= most).drop("__n")


def expand(seeds: DataFrame, corpus: DataFrame, *, parents: bool = True, children: bool = True, siblings: bool = True, max_expand: int = 50, scope: str | None = None, seed_bound: int | None = None, per_query: int | None = None) -> DataFrame:
    """Rows (query_id, id, pos, relation, seed_path, out_pos) in output order: seeds by rank, parents, children, siblings, each by corpus position.

    seeds: query_id, seed_rank, id, pos, node_path, parent_path; corpus: id, pos, node_path, parent_path (and `scope`, a column
    that must agree, such as a document's id). A chunk appears once per query, under the first relation that holds, and names the
    first seed that has it. At most max_expand rows per query come out, but never fewer than the seeds. seed_bound: what is known
    of the number of seeds (queries times k); up to SEED_ROWS they are broadcast. per_query: what is known of the number of a query's seeds.

    Of each wanted path only the first max(max_expand, per_query) + per_query rows can be shown: a row that another relation has taken stands in the output itself,
    and a path that is wanted for two relations gives the same rows to both.
    """
    key = [scope] if scope else []
    small = seed_bound is not None and seed_bound <= SEED_ROWS
    side = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    base = corpus.select("id", "pos", "node_path", "parent_path", *key)
    if per_query is None:
        per_query = seeds.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    most = max(max_expand, per_query)

    def asked(relation: str, priority: int, path: str) -> DataFrame:
        """The paths that a query wants for a relation, with the first seed that does."""
        first = F.min(F.struct("seed_rank", F.col("node_path").alias("seed_path"))).alias("seed")
        return seeds.where(F.col(path) != "").groupBy("query_id", F.col(path).alias("path"), *key).agg(first).select("query_id", "path", *key, F.lit(priority).alias("priority"), F.lit(relation).alias("relation"), "seed.*")

    def related(own: str, wanted: DataFrame) -> DataFrame:
        rows = first_rows(base.select("id", "pos", own, *key), own, side(wanted.select("path", *key).distinct()), most + per_query, key)
        return rows.join(side(wanted), ["path", *key]).select("query_id", "id", "pos", "priority", "relation", "seed_rank", "seed_path")

    found = seeds.select("query_id", "id", "pos", F.lit(0).alias("priority"), F.lit("seed").alias("relation"), "seed_rank", F.col("node_path").alias("seed_path"))
    if parents:
        found = found.unionByName(related("node_path", asked("parent", 1, "parent_path")))
    below = [asked(*x) for on, x in ((children, ("child", 2, "node_path")), (siblings, ("sibling", 3, "parent_path"))) if on]
    if below:
        found = found.unionByName(related("parent_path", below[0] if len(below) == 1 else below[0].unionByName(below[1])))
    # One row per chunk and query, under its first relation.
    once = found.groupBy("query_id", "id", "pos").agg(F.min(F.struct("priority", "seed_rank", "relation", "seed_path")).alias("best")).select("query_id", "id", "pos", "best.*")
    order = F.when(F.col("priority") == 0, F.col("seed_rank")).otherwise(F.col("pos"))
    ranked = once.withColumn("out_pos", F.row_number().over(W.partitionBy("query_id").orderBy("priority", order, "pos", "id")))
    return ranked.where(F.col("out_pos") <= most).where((F.col("out_pos") <= max_expand) | (F.col("priority") == 0)).select("query_id", "id", "pos", "relation", "seed_path", (F.col("out_pos") - 1).cast("long").alias("out_pos"))
