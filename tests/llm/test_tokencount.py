from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from treegrain.llm.queries import op5_token_counts
from treegrain.llm.tokencount import PairMerger, count_text, count_tokens, default_tokenizer

LIBRARY = Tokenizer.from_file(default_tokenizer())


def library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "\t", "a", "don't", "é", "漢", "12", "\x85", "\x1c"]), max_size=12).map("".join))
def test_counts_as_the_library_does(text):
    assert count_text(text, default_tokenizer()) == library(text)


def test_long_words():
    for text in ("a" * 20_000, "ab" * 5000, "漢字" * 2000, "x" * 3 + "é" * 4000):
        assert count_text(text, default_tokenizer()) == library(text)


def test_query_against_the_library(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op5_token_counts(spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {d: (len(t.encode()), library(t), library(t) > 1024) for d, t in docs.items()}


def test_nulls_repeats_and_empty(spark):
    shape = "doc_id long, text string, n_tokens string"
    rows = [(1, None, "x"), (1, "", None), (None, "hello world", None), (2, "hi", None), (2, "hi", None)]
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(spark.createDataFrame(rows, shape)).collect())
    assert out == [(0, 11, 2), (1, 0, 0), (1, 0, 0), (2, 2, 1), (2, 2, 1)]
    assert count_tokens(spark.createDataFrame([], shape)).count() == 0
    assert [r.over_limit for r in count_tokens(spark.createDataFrame([(1, "a b c", None)], shape), limit=2).collect()] == [True]


def test_forgetting_changes_nothing(monkeypatch):
    import treegrain.llm.tokencount as module

    monkeypatch.setattr(module, "REMEMBERED", 2)
    merger = PairMerger(default_tokenizer())
    words = ["alpha", "beta", "gamma", "alpha"]
    assert [merger[w] for w in words] == [library(w) for w in words] and len(merger) <= 2
