"""Retrieval queries over the driver's tables, with the SQL they are compared to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from treegrain.operators import bm25, dense, evaluate, fusion, retrieve
from treegrain.operators.chunks import with_paths
from treegrain.operators.expand import expand
from treegrain.session import spill_table, table

K = 5
CAP = 50
#: Ids of rows that stand for a label or a source begin here.
PARENT = 1_000_000_000_000


def label_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of embeddings as chunks label{l}.v{id}, and a row without a vector for each label."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.concat(F.lit("label"), F.col("label").cast("string"), F.lit(".v"), F.col("vec_id").cast("string")).alias("node_path"), "embedding")
    labels = e.groupBy("label").agg(F.lit(None).cast("array<float>").alias("embedding"))
    above = labels.select((F.lit(PARENT) + F.col("label")).alias("id"), (F.lit(PARENT) + F.col("label")).alias("pos"), F.concat(F.lit("label"), F.col("label").cast("string")).alias("node_path"), "embedding")
    return spill_table(spark, with_paths(rows.unionByName(above)), "index")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks for its neighbours."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def knn_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    query = e.where("vec_id = 0").select("embedding").first()[0]
    return dense.nearest(e, query, K, keys=["vec_id"])


def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense.nearest_batch(table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), K, key="vec_id", pos="vec_id")
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def _expansion(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    found = retrieve.dense_query(label_corpus(spark, sf_dir), vector_queries(spark, sf_dir), K, **options)
    return found.select("query_id", "out_pos", "id", F.when(~F.isnan("score"), F.col("score")).alias("score"), "relation", "seed_path")


def knn_expand_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, their labels' rows and the labels' other rows, at most 50 rows a query. A score of null stands for none."""
    return _expansion(spark, sf_dir)


def expand_parents_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expansion(spark, sf_dir, children=False, siblings=False)


def expand_siblings_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expansion(spark, sf_dir, parents=False, children=False, max_expand=20)


def expand_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap below the number of seeds keeps the seeds."""
    return _expansion(spark, sf_dir, max_expand=3)


def expand_children_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of every label's row; each label is a query of its own."""
    corpus = label_corpus(spark, sf_dir)
    seeds = corpus.where(F.col("id") >= PARENT).select((F.col("id") - PARENT).alias("query_id"), F.lit(0).alias("seed_rank"), "id", "pos", "node_path", "parent_path")
    return expand(seeds, corpus, parents=False, siblings=False, max_expand=30)


def expand_star_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as a tree; the ten dearest orders with their customers and those customers' other orders."""
    t = lambda n: table(spark, sf_dir, n)
    path = lambda *parts: F.concat_ws(".", *[F.concat(F.lit(p), F.col(c).cast("string")) for p, c in parts])
    region = t("region").select(F.col("r_regionkey").cast("long").alias("id"), path(("r", "r_regionkey")).alias("node_path"))
    nation = t("nation").select((F.col("n_nationkey") + 1000).cast("long").alias("id"), path(("r", "n_regionkey"), ("n", "n_nationkey")).alias("node_path"), "n_nationkey")
    customer = t("customer").join(F.broadcast(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("node_path").alias("above"))), "c_nationkey").select((F.col("c_custkey") + 1_000_000_000).alias("id"), F.concat("above", F.lit(".c"), F.col("c_custkey").cast("string")).alias("node_path"), F.col("c_custkey").alias("o_custkey"))
    joined = t("orders").select("o_orderkey", "o_custkey", "o_totalprice").join(customer.select("o_custkey", F.col("node_path").alias("above")), "o_custkey")
    order = joined.select((F.col("o_orderkey") + PARENT).alias("id"), F.concat("above", F.lit(".o"), F.col("o_orderkey").cast("string")).alias("node_path"), "o_totalprice")
    corpus = with_paths(region.unionByName(nation.drop("n_nationkey")).unionByName(customer.drop("o_custkey")).unionByName(order.drop("o_totalprice")).withColumn("pos", F.col("id")))
    top = order.orderBy(F.desc("o_totalprice"), "id").limit(10).withColumn("pos", F.col("id"))
    from pyspark.sql import Window as W

    seeds = with_paths(top).select(F.lit(0).cast("long").alias("query_id"), (F.row_number().over(W.orderBy(F.desc("o_totalprice"), "id")) - 1).alias("seed_rank"), "id", "pos", "node_path", "parent_path")
    return expand(seeds, corpus, max_expand=60, seed_bound=10)


def expand_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks c{conv}.t{turn}; the first turn of every conversation whose id is divisible by 100, with its siblings."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    corpus = with_paths(c.select("conv_id", "turn", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("pos"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".t"), F.col("turn").cast("string")).alias("node_path")))
    seeds = corpus.where("conv_id % 100 = 0 and turn = 0").select(F.col("conv_id").alias("query_id"), F.lit(0).alias("seed_rank"), "id", "pos", "node_path", "parent_path")
    return expand(seeds, corpus)


def rescore_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded rows scored by their own vectors, those below 0.1 left out unless they are seeds."""
    return _expansion(spark, sf_dir, rescore=True, min_score=0.1)


def tokenize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_frequencies(bm25.documents(table(spark, sf_dir, "documents"))).select("doc_id", "dl", "term", "tf")


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bm25.documents(table(spark, sf_dir, "documents"))
    return docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_len_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.statistics(bm25.documents(table(spark, sf_dir, "documents"))).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bm25.documents(table(spark, sf_dir, "documents"))
    df = doc_freq(spark, sf_dir)
    return df.crossJoin(F.broadcast(bm25.statistics(docs))).select("term", "df", F.round(bm25.idf(F.col("df"), F.col("n")), 6).alias("idf"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 is a query."""
    return table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")


def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(table(spark, sf_dir, "documents"), text_queries(spark, sf_dir), 10)


def source_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of documents as chunks {source}.d{doc_id} with letter-count vectors, and a row without a vector for each source. Texts stay where they are."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "text", F.concat(F.coalesce("source", F.lit("none")), F.lit(".d"), F.col("doc_id").cast("string")).alias("node_path"))
    sources = d.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.min("doc_id").alias("least"))
    above = sources.select((F.lit(PARENT) + F.col("least")).alias("id"), (F.lit(PARENT) + F.col("least")).alias("pos"), F.col("source").alias("node_path"), F.lit(None).cast("array<float>").alias("embedding"))
    return spill_table(spark, with_paths(dense.encode(rows, dense.letters).drop("text").unionByName(above)), "index")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _hybrid_queries(spark: SparkSession, sf_dir: str, corpus: DataFrame) -> DataFrame:
    vectors = corpus.where((F.col("id") < PARENT) & (F.col("id") % 100 == 0)).select(F.col("id").alias("query_id"), "embedding")
    return vectors.join(text_queries(spark, sf_dir), "query_id")


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by letter counts and the ten best by BM25, fused."""
    corpus = source_corpus(spark, sf_dir)
    semantic = dense.nearest_batch(corpus, corpus.where((F.col("id") < PARENT) & (F.col("id") % 100 == 0)).select(F.col("id").alias("query_id"), "embedding"), 10)
    lexical = bm25.search(_texts(spark, sf_dir), text_queries(spark, sf_dir), 10, key="id").withColumnRenamed("doc_id", "id")
    return fusion.fuse([semantic, lexical], 10)


def hybrid_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = source_corpus(spark, sf_dir)
    return retrieve.hybrid_query(corpus, _hybrid_queries(spark, sf_dir, corpus), 10, texts=_texts(spark, sf_dir), expand_subtree=False)


def hybrid_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = source_corpus(spark, sf_dir)
    return retrieve.hybrid_query(corpus, _hybrid_queries(spark, sf_dir, corpus), 10, texts=_texts(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.array(F.concat(F.lit("label"), F.col("label").cast("string"))).alias("prefixes"))


def eval_recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision of flat and of expanded retrieval, where a query's own label is what is relevant."""
    corpus, queries, labelled = label_corpus(spark, sf_dir), vector_queries(spark, sf_dir), _labelled(spark, sf_dir)
    flat = retrieve.dense_query(corpus, queries, K, expand_subtree=False)
    full = retrieve.dense_query(corpus, queries, K, max_expand=20)
    return evaluate.summarize("flat", evaluate.per_query(flat, corpus, labelled)).unionByName(evaluate.summarize("expanded", evaluate.per_query(full, corpus, labelled)))


def eval_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.lift(eval_recall_precision(spark, sf_dir), "flat", "expanded")


_COSINE = "round(list_inner_product({a}::DOUBLE[], {b}::DOUBLE[]) / (greatest(sqrt(list_inner_product({a}::DOUBLE[], {a}::DOUBLE[])), 1e-12) * greatest(sqrt(list_inner_product({b}::DOUBLE[], {b}::DOUBLE[])), 1e-12)), 6)"
_CORPUS = f"""corpus AS (SELECT vec_id AS id, vec_id AS pos, 'label' || label || '.v' || vec_id AS node_path, 'label' || label AS parent_path, embedding FROM embeddings
  UNION ALL SELECT {PARENT} + label, {PARENT} + label, 'label' || label, '', NULL FROM (SELECT DISTINCT label FROM embeddings))"""
_RANKED = f"""ranked AS (SELECT * FROM (SELECT q.vec_id AS query_id, c.id, c.pos, c.node_path, c.parent_path, {_COSINE.format(a="c.embedding", b="q.embedding")} AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.format(a="c.embedding", b="q.embedding")} DESC, c.pos) - 1 AS seed_rank
  FROM corpus c, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE c.embedding IS NOT NULL) WHERE seed_rank < {K})"""


def _expand_sql(seeds: str, *, parents: bool = True, children: bool = True, siblings: bool = True, cap: int = CAP) -> str:
    """CTE `expanded` from CTEs `corpus` and `seeds`."""
    parts = [f"SELECT query_id, id, pos, 0 AS pri, 'seed' AS relation, seed_rank, node_path AS seed_path FROM {seeds}"]
    for on, pri, relation, own, other in ((parents, 1, "parent", "node_path", "parent_path"), (children, 2, "child", "parent_path", "node_path"), (siblings, 3, "sibling", "parent_path", "parent_path")):
        if on:
            parts.append(f"SELECT s.query_id, c.id, c.pos, {pri}, '{relation}', s.seed_rank, s.node_path FROM {seeds} s JOIN corpus c ON c.{own} = s.{other} AND s.{other} <> ''")
    return f"""found AS ({" UNION ALL ".join(parts)}),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY pri, seed_rank) AS n FROM found) WHERE n = 1),
expanded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pri, CASE WHEN pri = 0 THEN seed_rank ELSE pos END, pos, id) - 1 AS out_pos FROM once) WHERE out_pos < {cap} OR pri = 0)"""


def _knn_sql(**options) -> str:
    return f"""WITH {_CORPUS}, {_RANKED}, {_expand_sql("ranked", **options)}
SELECT e.query_id, e.out_pos, e.id, r.score, e.relation, e.seed_path FROM expanded e LEFT JOIN ranked r USING (query_id, id)"""


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]'), lambda x: length(x) > 1)"
_TF = f"""docs AS (SELECT doc_id, text, {_TOKENS} AS terms FROM documents),
tf AS (SELECT doc_id, len(terms) AS dl, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), stats AS (SELECT count(*) AS n, coalesce(avg(len(terms)), 1.0) AS avgdl FROM docs)"""
_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1.0)"


def _bm25_sql(k: int) -> str:
    return f"""{_TF}, qterms AS (SELECT doc_id AS query_id, unnest(list_distinct(terms)) AS term FROM docs WHERE doc_id % 100 = 0),
scored AS (SELECT query_id, doc_id, round(sum({_IDF} * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qterms JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored) WHERE rank < {k})"""


_VECTOR = "list_value(" + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::DOUBLE" for c in "abcdefgh") + ")"


def _hybrid_sql(each: int, k: int) -> str:
    c = _COSINE.format(a="a.v", b="q.v")
    return f"""{_bm25_sql(each)}, vectors AS (SELECT doc_id, {_VECTOR} AS v FROM documents),
semantic AS (SELECT * FROM (SELECT q.doc_id AS query_id, a.doc_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY {c} DESC, a.doc_id) - 1 AS rank FROM vectors a, (SELECT * FROM vectors WHERE doc_id % 100 = 0) q) WHERE rank < {each}),
lists AS (SELECT query_id, doc_id AS id, 0 AS branch, rank FROM semantic UNION ALL SELECT query_id, doc_id, 1, rank FROM lexical),
sums AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS rrf, min(branch * 1000000 + rank) AS first FROM lists GROUP BY ALL),
fused AS (SELECT * FROM (SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first, id) - 1 AS rank FROM sums) WHERE rank < {k})"""


_SOURCES = f"""corpus AS (SELECT doc_id AS id, doc_id AS pos, coalesce(source, 'none') || '.d' || doc_id AS node_path, coalesce(source, 'none') AS parent_path FROM documents
  UNION ALL SELECT {PARENT} + min(doc_id), {PARENT} + min(doc_id), coalesce(source, 'none'), '' FROM documents GROUP BY coalesce(source, 'none'))"""
_EVAL = f"""{_CORPUS}, {_RANKED}, {_expand_sql("ranked", cap=20)},
truth AS (SELECT vec_id AS query_id, 'label' || label AS prefix FROM embeddings WHERE vec_id % 100 = 0),
relevant AS (SELECT query_id, greatest(count(id), 1) AS n FROM truth LEFT JOIN corpus ON node_path = prefix OR starts_with(node_path, prefix || '.') GROUP BY query_id),
results AS (SELECT 'flat' AS condition, query_id, id FROM ranked UNION ALL SELECT 'expanded', query_id, id FROM expanded),
judged AS (SELECT condition, query_id, count(*) AS n_results, count(*) FILTER (c.node_path = t.prefix OR starts_with(c.node_path, t.prefix || '.')) AS hits FROM results JOIN corpus c USING (id) JOIN truth t USING (query_id) GROUP BY ALL),
report AS (SELECT condition, round(avg(hits / n), 3) AS recall, round(avg(hits / n_results), 3) AS precision, round(avg(n_results), 1) AS avg_result_size FROM judged JOIN relevant USING (query_id) GROUP BY condition)"""
_TREE = f"""customers AS (SELECT c_custkey, 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey),
priced AS (SELECT o_orderkey + {PARENT} AS id, path || '.o' || o_orderkey AS node_path, path AS parent_path, o_totalprice FROM orders JOIN customers ON o_custkey = c_custkey),
corpus AS (SELECT id, id AS pos, node_path, parent_path FROM (SELECT r_regionkey::BIGINT AS id, 'r' || r_regionkey AS node_path, '' AS parent_path FROM region
  UNION ALL SELECT n_nationkey + 1000, 'r' || n_regionkey || '.n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT c_custkey + 1000000000, path, regexp_replace(path, '\\.[^.]*$', '') FROM customers
  UNION ALL SELECT id, node_path, parent_path FROM priced)),
seeds AS (SELECT 0::BIGINT AS query_id, row_number() OVER (ORDER BY o_totalprice DESC, id) - 1 AS seed_rank, id, id AS pos, node_path, parent_path FROM priced ORDER BY o_totalprice DESC, id LIMIT 10)"""

QUERIES = {
    f.__name__: f
    for f in (
        knn_top5, knn_batch_topk, knn_expand_subtree, expand_parents_only, expand_siblings_only, expand_capped, expand_children_only, expand_star_hierarchy, expand_conversations,
        rescore_min_score, tokenize_tf, doc_freq, doc_len_stats, bm25_idf, bm25_top10, rrf_fuse, hybrid_top10, hybrid_expand, eval_recall_precision, eval_lift,
    )
}

_OUT = "query_id, id, pos, relation, seed_path, out_pos"
ORACLE_SQL = {
    "knn_top5": f"SELECT a.vec_id, {_COSINE.format(a='a.embedding', b='q.embedding')} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT {K}",
    "knn_batch_topk": f"WITH {_CORPUS}, {_RANKED} SELECT query_id, id AS vec_id, score, seed_rank AS rank FROM ranked",
    "knn_expand_subtree": _knn_sql(),
    "expand_parents_only": _knn_sql(children=False, siblings=False),
    "expand_siblings_only": _knn_sql(parents=False, children=False, cap=20),
    "expand_capped": _knn_sql(cap=3),
    "expand_children_only": f"WITH {_CORPUS}, seeds AS (SELECT id - {PARENT} AS query_id, 0 AS seed_rank, id, pos, node_path, parent_path FROM corpus WHERE id >= {PARENT}), {_expand_sql('seeds', parents=False, siblings=False, cap=30)} SELECT {_OUT} FROM expanded",
    "expand_star_hierarchy": f"WITH {_TREE}, {_expand_sql('seeds', cap=60)} SELECT {_OUT} FROM expanded",
    "expand_conversations": f"WITH turns AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), corpus AS (SELECT conv_id, turn, conv_id * 1000000 + turn AS id, conv_id * 1000000 + turn AS pos, 'c' || conv_id || '.t' || turn AS node_path, 'c' || conv_id AS parent_path FROM turns), seeds AS (SELECT conv_id AS query_id, 0 AS seed_rank, id, pos, node_path, parent_path FROM corpus WHERE conv_id % 100 = 0 AND turn = 0), {_expand_sql('seeds')} SELECT {_OUT} FROM expanded",
    "rescore_min_score": f"""WITH {_CORPUS}, {_RANKED}, {_expand_sql("ranked")}, scored AS (SELECT e.query_id, e.out_pos AS o, e.id, CASE WHEN c.embedding IS NULL THEN 0.0 ELSE {_COSINE.format(a="c.embedding", b="q.embedding")} END AS score, relation, seed_path FROM expanded e JOIN corpus c USING (id) JOIN embeddings q ON q.vec_id = e.query_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) - 1 AS out_pos, id, score, relation, seed_path FROM scored WHERE relation = 'seed' OR score >= 0.1""",
    "tokenize_tf": f"WITH {_TF} SELECT doc_id, dl, term, tf FROM tf",
    "doc_freq": f"WITH {_TF} SELECT term, df FROM df",
    "doc_len_stats": f"WITH {_TF} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_idf": f"WITH {_TF} SELECT term, df, round({_IDF}, 6) AS idf FROM df, stats",
    "bm25_top10": f"WITH {_bm25_sql(10)} SELECT query_id, doc_id, score, rank FROM lexical",
    "rrf_fuse": f"WITH {_hybrid_sql(10, 10)} SELECT query_id, id, rrf, rank FROM fused",
    "hybrid_top10": f"WITH {_hybrid_sql(40, 10)} SELECT query_id, rank AS out_pos, f.id, rrf, 'seed' AS relation, coalesce(source, 'none') || '.d' || f.id AS seed_path FROM fused f JOIN documents d ON d.doc_id = f.id",
    "hybrid_expand": f"WITH {_hybrid_sql(40, 10)}, {_SOURCES}, seeds AS (SELECT query_id, rank AS seed_rank, id, pos, node_path, parent_path FROM fused JOIN corpus USING (id)), {_expand_sql('seeds')} SELECT e.query_id, out_pos, e.id, f.rrf, relation, seed_path FROM expanded e LEFT JOIN fused f USING (query_id, id)",
    "eval_recall_precision": f"WITH {_EVAL} SELECT * FROM report",
    "eval_lift": f"""WITH {_EVAL}, row AS (SELECT max(recall) FILTER (condition = 'flat') AS base, max(recall) FILTER (condition = 'expanded') AS other FROM report)
SELECT base, other, round((other - base) / greatest(base, 1e-9), 3) AS lift, CASE WHEN other - base > 0.02 THEN 'better' WHEN other - base < -0.02 THEN 'worse' ELSE 'equal' END AS verdict FROM row""",
}
