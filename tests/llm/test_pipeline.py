import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.test_jaccard import brute as brute_classes
from tests.llm.test_substring import brute as brute_cut
from treegrain.llm import quality, segment
from treegrain.llm.decontaminate import tokens
from treegrain.llm.textblock import mix, raw

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    model = quality.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    docs = [(d, t) for d, t in docs if model.score(*raw(pa.array([t])))[0] >= quality.THRESHOLD]
    docs = [(d, t) for (d, t), (c, _) in zip(docs, brute_classes(docs)) if c == d]
    docs = [(d, " ".join(k) if g else t) for (d, t), (n, g, k) in zip(docs, brute_cut([t for _, t in docs])) if not g or g < n]
    items = [" ".join(tokens(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if not any(i in " ".join(tokens(t)) for i in items)]
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in docs} and len(docs) > 50
    texts = dict(docs)
    pieces = segment._pieces(segment.default_model())
    for r in rows:
        assert r.round_trip and segment.decode(np.array(r.ids), pieces).decode() == texts[r.doc_id]
    d, t = docs[0]
    data, at = raw(pa.array([t]))
    key = np.array([(d + segment.SEED * int(segment._SIBLING)) % 2**64], np.uint64)
    own = segment.Texts(segment.Store(pieces, segment.ALPHA), data, at, mix(key))
    want = [segment.identifiers(own, x["edges"], x["units"]).tolist() for x in segment.sample_texts(own, segment.SAMPLES)[0]]
    assert [list(r.ids) for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.sample)] == want


def test_stages_take_odd_rows(spark, small):
    """Nulls anywhere, empty and long texts, repeats, empty tables, extra columns with clashing names: no stage fails, and all but the last keep the columns."""
    odd = [(None, None, None, None, None), (1, "", None, "s", None), (2, None, "en", None, 5), (3, "word " * 20_000, "en", "s", 1), (4, "the end of it all is near", None, None, 3), (4, "the end of it all is near", None, None, 3)]
    extra = "'a' AS score, 'b' AS did, 'c' AS th, 1 AS nk, 2.5 AS spans, 'd' AS __score, array(1) AS keys, 'e' AS class_id"
    for df in (spark.createDataFrame(odd, DOCS), spark.createDataFrame([], DOCS)):
        wide = df.selectExpr("*", *extra.split(", "))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, wide, small)
            rows = out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == wide.columns and len(rows) <= len(odd)
