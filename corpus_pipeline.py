"""A corpus pipeline of five stages over the documents table, each one operator of treegrain.llm.

In every stage a null text counts as empty and a null doc_id as a key like any other, rows that are equal are copies of each other, texts may be of any length, an empty
table gives no rows, and extra columns, whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from treegrain.llm import decontaminate, jaccard, quality, segment, substring
from treegrain.session import discard, fresh_names, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is trained on the whole documents table's labelled rows, as the operator's query is.

    An empty text is scored by the model's bias; equal texts share their fate; without labels every score is 0.5 and nothing is accepted.
    """
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    (score,) = fresh_names(docs, "__score")
    return quality.score_column(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest doc_id, of equal ids the smallest hash of its text, of equal rows one. Texts without words are one class."""
    return jaccard.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of words that also start elsewhere in what is left. Those of which nothing is left go; empty ones, which lose nothing, stay."""
    return substring.cut_documents(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Empty texts hold none; equal rows go or stay together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def segmentation_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document that is left, with identifiers; one without pieces for an empty text."""
    return segment.sample_segmentations(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece segmentation", segmentation_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each keeps is written to the shared folder and read again by the next, and then what the stages before it wrote is deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(spark, lambda: stage(spark, docs, sf_dir), "stage")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the classifier, the sampled segmentations or the tests' brute force at this size; see tests/llm/test_pipeline.py.
ORACLE_SQL = None
