"""Structured Streaming: incremental ingest, running term statistics, daily quotas, resumable summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from treegrain.operators.bm25 import documents


def ingest(stream: DataFrame, chunker: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Chunk what arrives and append it to the index at `path`. A batch that is run again after a failure replaces its own part, so nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        chunker(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_statistics(stream: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Running (term, df) of a stream of documents, for update or complete mode; a document's terms count once."""
    docs = documents(stream, key, text)
    return docs.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def daily_counts(stream: DataFrame, *, user: str = "user_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(user_id, day, n) of a stream of requests by UTC day; what comes later than the watermark is dropped, and closed days leave the state."""
    windowed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 day"), F.col(user).alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select("user_id", F.to_date("window.start").alias("day"), "n")


def summarize(stream: DataFrame, model: Callable[[list[str]], list[str]], cache_path: str, checkpoint: str) -> StreamingQuery:
    """Summaries of chunks that arrive, one part of the cache per batch; chunks whose key is cached are left out."""
    from treegrain.operators import summaries

    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        schema = "key string, summary string, batch int"
        try:
            cache = spark.read.schema(schema).parquet(cache_path).where(F.col("batch") != number)
            cache.limit(1).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            cache = spark.createDataFrame([], schema)
        summaries.generate(batch, cache, model).write.mode("overwrite").parquet(f"{cache_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
