"""Sinks: indexes as Parquet tables, reports as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def append_index(chunks: DataFrame, path: str) -> None:
    """Add chunks with their vectors to an index."""
    chunks.write.mode("append").parquet(path)


def reset_index(chunks: DataFrame, path: str) -> None:
    """Make an index of the same columns empty."""
    chunks.limit(0).write.mode("overwrite").parquet(path)


def write_postings(tf: DataFrame, path: str, *, buckets: int = 64) -> None:
    """Inverted index clustered by term: files by a hash of the term, sorted within, so that a query's terms read few of them."""
    tf.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str], *, buckets: int = 64) -> DataFrame:
    """Postings of some terms; only their buckets' files are read."""
    wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct()
    return spark.read.parquet(path).where(F.col("bucket").isin([r["b"] for r in wanted.collect()]) & F.col("term").isin(terms)).drop("bucket")


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
