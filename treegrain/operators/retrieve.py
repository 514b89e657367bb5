"""Retrieval: dense or hybrid seeds, structural expansion, re-scoring, filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from treegrain.functions.vectors import cosine
from treegrain.operators import bm25, dense, fusion
from treegrain.operators.expand import SEED_ROWS, expand
from treegrain.session import spill_table


def _expanded(ranked: DataFrame, corpus: DataFrame, k: int, n_queries: int, options: dict, do_expand: bool) -> DataFrame:
    """Seeds with their neighbours. The seeds' rows are looked up once and written out, since every relation starts from them."""
    scope, bound = options.get("scope"), k * n_queries
    rows = corpus.select("id", "pos", "node_path", "parent_path", *([scope] if scope else []))
    seeds = ranked.select("query_id", "id", F.col("rank").alias("seed_rank"))
    seeds = spill_table(corpus.sparkSession, rows.join(F.broadcast(seeds) if bound <= SEED_ROWS else seeds, "id"), "seed-rows")
    if not do_expand:
        options = {**options, "parents": False, "children": False, "siblings": False}
    return expand(seeds, corpus, seed_bound=bound, per_query=k, **options)


def _asking(seeds: DataFrame, corpus: DataFrame) -> int:
    """Number of queries that found seeds; if none did, an empty corpus is an error."""
    n = seeds.select("query_id").distinct().count()
    if not n:
        dense.check_size(corpus, 1)
    return n


def dense_query(corpus: DataFrame, queries: DataFrame, k: int = 10, *, expand_subtree: bool = True, rescore: bool = False, min_score: float = 0.0, vector: str = "embedding", **options) -> DataFrame:
    """(query_id, out_pos, id, score, relation, seed_path): nearest rows of each query and their structural neighbours.

    corpus: id, pos, node_path, parent_path, embedding; queries: query_id, embedding. Without re-scoring only seeds have a score, others NaN. With it, rows are
    scored by their stored vectors (what encoding them again would give) and sorted by score, then by structural order; min_score
    then drops expanded rows below it, never seeds. An empty corpus is an error. options: see expand().
    """
    # Seeds are needed twice; k rows a query are written out rather than searched for twice.
    ranked = spill_table(corpus.sparkSession, dense.nearest_batch(corpus, queries, k, vector=vector), "seeds")
    n = _asking(ranked, corpus)
    rows = _expanded(ranked, corpus, k, n, options, expand_subtree)
    if not rescore:
        scored = rows.join(ranked.select("query_id", "id", "score"), ["query_id", "id"], "left")
        return scored.select("query_id", "out_pos", "id", F.coalesce("score", F.lit(float("nan"))).alias("score"), "relation", "seed_path")
    own = rows.join(corpus.select("id", F.col(vector).alias("__v")), "id").join(queries.select("query_id", F.col(vector).alias("__q")), "query_id")
    own = own.withColumn("score", F.round(F.coalesce(cosine(F.col("__v"), F.col("__q")), F.lit(0.0)), 6)).drop("__v", "__q")
    if min_score > 0:
        own = own.where((F.col("relation") == "seed") | (F.col("score") >= min_score))
    placed = own.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "out_pos")))
    return placed.select("query_id", (F.col("place") - 1).cast("long").alias("out_pos"), "id", "score", "relation", "seed_path")


def hybrid_query(corpus: DataFrame, queries: DataFrame, k: int = 10, *, use_hybrid: bool = True, expand_subtree: bool = True, rrf_k: int = 60, bm25_k1: float = bm25.K1, bm25_b: float = bm25.B, bm25_candidates: int | None = None, semantic_candidates: int | None = None, vector: str = "embedding", texts: DataFrame | None = None, **options) -> DataFrame:
    """(query_id, out_pos, id, rrf, relation, seed_path): seeds from BM25 and vectors, fused by reciprocal rank, then expanded.

    corpus also needs text, unless texts (id, text) has them; queries also text. Each branch gives max(4k, 20) candidates unless told otherwise (0 counts as not told). use_hybrid=False is dense_query().
    """
    if not use_hybrid:
        return dense_query(corpus, queries, k, expand_subtree=expand_subtree, vector=vector, **options).withColumnRenamed("score", "rrf")
    most = max(4 * k, 20)
    semantic = dense.nearest_batch(corpus, queries, semantic_candidates or most, vector=vector)
    lexical = bm25.search((corpus if texts is None else texts).where("text is not null").select("id", "text"), queries.select("query_id", "text"), bm25_candidates or most, k1=bm25_k1, b=bm25_b, key="id").withColumnRenamed("doc_id", "id")
    fused = spill_table(corpus.sparkSession, fusion.fuse([semantic, lexical], k, rrf_k=rrf_k), "seeds")
    rows = _expanded(fused, corpus, k, _asking(fused, corpus), options, expand_subtree)
    return rows.join(fused.select("query_id", "id", "rrf"), ["query_id", "id"], "left").select("query_id", "out_pos", "id", "rrf", "relation", "seed_path")
