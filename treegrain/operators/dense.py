"""Exact cosine top-k over ARRAY<FLOAT> columns."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from treegrain.functions.vectors import LETTERS, checked, cosine, normalize
from treegrain.operators.topk import FOUND, TopK, choose
from treegrain.session import gather, ship_code, spill_table

#: Queries that one pass over the corpus answers; their matrix is what is broadcast (at 1,000 dimensions 32 MB).
QUERY_BLOCK = 4096
#: Rows of the corpus that one product takes.
ROWS = 512


def index(chunks: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """chunks with unit vectors of a checked length, computed once when the table is built."""
    return chunks.withColumn(vector, normalize(checked(F.col(vector), dim)).cast("array<float>"))


def encode(chunks: DataFrame, encoder: Callable[[list[str]], np.ndarray], *, text: str = "text", vector: str = "embedding") -> DataFrame:
    """chunks with a vector of each text. encoder is called with lists of texts, in each Python worker; a loader can cache its model there."""
    ship_code(chunks.sparkSession)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(np.asarray(encoder(s.fillna("").tolist()), np.float32)))

    return chunks.withColumn(vector, F.pandas_udf(each, "array<float>")(F.col(text)))


def letters(texts: list[str]) -> np.ndarray:
    """An encoder without weights: how often each of a..h occurs in a text, ignoring case."""
    wanted = np.frombuffer(LETTERS.encode(), np.uint8)
    return np.array([np.bincount(np.frombuffer(t.lower().encode(), np.uint8), minlength=256)[wanted] for t in texts], np.float32).reshape(len(texts), len(LETTERS))


def nearest(corpus: DataFrame, query: list[float], k: int, *, vector: str = "embedding", keys: list[str] | None = None) -> DataFrame:
    """The k rows most like one vector: score (rounded to 6 places, ties by pos) and the rows' keys. Columns other than those aren't read.

    An empty corpus is an error; asking for more rows than there are gives all, with a warning.
    """
    if k < 1:
        raise ValueError("k must be positive")
    keys = keys or ["id", "pos"]
    scored = corpus.select(*keys, F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    return scored.orderBy(F.desc("score"), keys[-1]).limit(k)


def check_size(corpus: DataFrame, k: int) -> int:
    """min(k, rows), a RuntimeError for an empty corpus, a warning if there are fewer than k."""
    n = corpus.limit(k).count()
    if n == 0:
        raise RuntimeError("the index is empty")
    if n < k:
        warnings.warn(f"only {n} rows to choose {k} from", stacklevel=2)
    return n


def _local_top(shared, k: int, vector: str, key: str, pos: str):
    """Of each task's corpus rows, the k best for every query: matrix products of at most ROWS rows, whose best are chosen without sorting the rest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best = TopK(k, len(ids))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                names = b.schema.names
                column = b.column(names.index(vector))
                if not (np.asarray(column.value_lengths()) == matrix.shape[1]).all():
                    raise ValueError(f"expected {matrix.shape[1]} dimensions")
                rows = np.asarray(column.flatten(), np.float64).reshape(b.num_rows, -1)
                rows = rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-12)
                own, place = b.column(names.index(key)).to_numpy(), b.column(names.index(pos)).to_numpy()
                by = np.lexsort((own, place))
                top, scores = choose(np.rint(matrix @ rows[by].T * 1e6).astype(np.int64), k)
                best.add(np.repeat(ids, top.shape[1]), own[by][top].ravel(), place[by][top].ravel(), scores.ravel() / 1e6)
        yield best.rows()

    return each


def nearest_batch(corpus: DataFrame, queries: DataFrame, k: int, *, vector: str = "embedding", key: str = "id", pos: str = "pos", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, pos, score, rank) of the k rows most like each query (query_id, embedding); rank from 0, ties by pos.

    Queries meet the corpus in blocks of at most about `block` rows: only one block at a time is on the driver and broadcast, a bound that
    no table can exceed. Each block is one pass over the corpus that keeps k rows per task and query, in at most twice as many tasks as there are cores; with more than one block,
    a block's candidates are written to the shared folder before the next begins. Scores are rounded to 6 places before ranking.
    Rows and queries without a vector are left out; vectors of another length than the queries' are an error.
    """
    spark = corpus.sparkSession
    ship_code(spark)
    asked = queries.select("query_id", vector).where(F.col(vector).isNotNull())
    first = asked.limit(block + 1).collect()
    blocks = 1 if len(first) <= block else -(-asked.count() // block)
    source = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(pos).cast("long").alias(pos) if pos != key else F.col(key).cast("long").alias("__pos"), vector)
    out = spark.createDataFrame([], FOUND)
    for n in range(blocks):
        part = sorted(first if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).collect(), key=lambda r: r[0])
        if not part:
            continue
        matrix = np.array([r[1] for r in part], np.float64)
        matrix = matrix / np.maximum(np.sqrt((matrix * matrix).sum(1, keepdims=True)), 1e-12)
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in part], np.int64), matrix))
        local = gather(source).mapInArrow(_local_top(shared, k, vector, key, pos if pos != key else "__pos"), FOUND)
        if blocks > 1:
            local = spill_table(spark, local, "nearest")
            shared.destroy()
        out = local if blocks == 1 else out.unionByName(local)
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "pos", "id")))
    return ranked.where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("long"))
