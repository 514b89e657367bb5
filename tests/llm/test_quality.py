import zlib

import numpy as np
import pyarrow as pa

from treegrain.llm.quality import Model, features, fit, score_documents, train
from treegrain.llm.queries import op9_quality_classifier
from treegrain.llm.textblock import raw

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, medium):
    rows = {r.doc_id: r for r in op9_quality_classifier(spark, medium).collect()}
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    assert len(rows) == docs.count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(rows[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{medium}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(held) > 60 and np.mean([p == q for p, q in held]) > 0.93


def test_scores_see_the_text_only(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    base = {r.doc_id: r.score for r in score_documents(docs, labels).collect()}
    # Held-out labels change nothing.
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    assert {r.doc_id: r.score for r in score_documents(docs, flipped).collect()} == base
    other = docs.selectExpr("doc_id", "text", "'zz' AS lang", "'nowhere' AS source", "0 AS n_chars")
    assert {r.doc_id: r.score for r in score_documents(other, labels).collect()} == base


def test_batches_score_as_single_texts():
    texts = ["one two", "", "é é é", "one two", "a"]
    model = train(["good text here"] * 5 + ["bad!!! bad!!!"] * 5, np.array([1] * 5 + [0] * 5), epochs=20)
    together = model.score(*raw(pa.array(texts)))
    assert np.allclose(together, [model.score(*raw(pa.array([t])))[0] for t in texts]) and together[0] == together[3]
    good, bad = model.score(*raw(pa.array(["good text here", "bad!!! bad!!!"])))
    assert good > 0.5 > bad


def test_features_stay_within_documents():
    data, at = raw(pa.array(["abc", "de", "fgh i"]))
    for doc, bucket in features(data, at):
        assert len(doc) == len(bucket)
    apart = sum(sum(len(b) for _, b in features(*raw(pa.array([t])))) for t in ("abc", "de", "fgh i"))
    assert sum(len(b) for _, b in features(data, at)) == apart


def test_nulls_repeats_and_empty(spark):
    shape = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", None), (None, "abc", None), (3, "abc", None), (3, "abc", None)], shape)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, None), (None, 1, 0), (2, 7, 0), (5, 1, 0)], LABELS)
    out = score_documents(docs, labels).collect()
    assert len(out) == 5 and len({r.score for r in out if r.doc_id in (1, 2)}) == 1 and len({r.score for r in out if r.doc_id not in (1, 2)}) == 1
    assert [r.held_out for r in out if r.doc_id is None] == [True]
    assert {(r.score, r.predicted) for r in score_documents(docs, labels.limit(0)).collect()} == {(0.5, 0)}
    assert score_documents(docs.limit(0), labels).count() == 0
    assert isinstance(fit(docs, labels, limit=1), Model)
