"""The queries of this subpackage: each applies one operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from treegrain.llm import chat, decontaminate, fingerprint, htmlcut, jaccard, oracles, quality, segment, sharding, substring, tokencount
from treegrain.session import table


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of all documents, and where a ninth shard would put them."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.edit_test(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, with that item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the adversarial conversation -7, rendered and read back."""
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated windows of 35 words."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"), digest_only=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return segment.sample_segmentations(table(spark, sf_dir, "documents"), ids=False).drop("ids")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return htmlcut.extract_pages(table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_rendezvous_sharding,
        op2_merkle_fingerprints,
        op3_decontamination,
        op4_chat_formatting,
        op5_token_counts,
        op6_substring_dedup,
        op7_sampled_segmentation,
        op8_html_extraction,
        op9_quality_classifier,
        op10_ngram_jaccard,
    )
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
