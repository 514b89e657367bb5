"""Summaries of chunks: a cache by content key, the chunks still to do, and summaries applied to texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from treegrain.functions.text import chunk_key, summary_prompt


_CACHE = "model string, generated_at string, n_summaries long, summaries map<string,string>"


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, summary) of a JSON cache: one file {model, generated_at, n_summaries, summaries: {key: summary}}, or a folder of such objects, one a line, as save_cache() leaves it.

    A path that isn't there is an empty cache. A key that was written more than once counts once.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return spark.createDataFrame([], "key string, summary string")
    rows = spark.read.schema(_CACHE).option("multiLine", not store.getFileStatus(at).isDirectory()).json(path)
    return rows.select(F.explode("summaries").alias("key", "summary")).groupBy("key").agg(F.max("summary").alias("summary"))


def save_cache(cache: DataFrame, path: str, *, model: str | None = None, mode: str = "overwrite") -> None:
    """Write (key, summary) as the lines of a folder that load_cache() reads; a table of any size is written by its own tasks."""
    cache.select(F.lit(model).alias("model"), F.current_timestamp().cast("string").alias("generated_at"), F.lit(1).cast("long").alias("n_summaries"), F.create_map("key", "summary").alias("summaries")).write.mode(mode).json(path)


def resume(chunks: DataFrame, path: str, model: Callable[[list[str]], list[str]], *, every: int = 500, name: str | None = None) -> int:
    """Summarize the chunks that the cache at `path` lacks and add them to it, about `every` at a time; the number of chunks that were left to do.

    What a run that fails has added stays, and the next one goes on from there.
    """
    spark = chunks.sparkSession
    left = todo(chunks, load_cache(spark, path)).count()
    blocks = -(-left // every)
    for k in range(blocks):
        part = chunks.where(F.pmod(F.xxhash64("node_path", "text"), F.lit(blocks)) == k)
        save_cache(generate(part, load_cache(spark, path), model), path, model=name, mode="append")
    return left


def todo(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose key is not in the cache."""
    return chunks.withColumn("key", chunk_key(F.col("node_path"), F.col("text"))).join(cache.select("key"), "key", "left_anti")


def generate(chunks: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """(key, summary) of the chunks still to do. model gets lists of prompts in each Python worker; partitions bound how many run at once."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "summary": model(b["prompt"].tolist())})

    return todo(chunks, cache).select("key", summary_prompt(F.col("node_path"), F.col("text")).alias("prompt")).mapInPandas(each, "key string, summary string")


def apply(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks with the text of those that have a summary replaced by their path and it."""
    keyed = chunks.withColumn("__key", chunk_key(F.col("node_path"), F.col("text"))).join(cache.select(F.col("key").alias("__key"), F.col("summary").alias("__summary")), "__key", "left")
    return keyed.withColumn("text", F.when(F.col("__summary").isNotNull(), F.concat("node_path", F.lit("\n"), "__summary")).otherwise(F.col("text"))).drop("__key", "__summary")
