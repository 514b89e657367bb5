import hashlib
import random
import re
from collections import Counter

import numpy as np

from treegrain.llm.fmindex import FMIndex, WaveletMatrix, suffix_array
from treegrain.llm.queries import op6_substring_dedup
from treegrain.llm.substring import cut_documents, remove_repeats, repeated_intervals

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def brute(docs, window=35):
    """{row: (n_words, n_removed, kept)} of texts in a list."""
    words = [WORD.findall(t or "") for t in docs]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


def check(df, rows, **options):
    want = sorted((d if d is not None else -1, n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for (d, _), (n, g, k) in zip(rows, brute([t for _, t in rows], options.get("window", 35))))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, **options).collect())
    assert got == want


def test_index_parts():
    rng = np.random.default_rng(2)
    for n, sigma in ((1, 1), (50, 2), (300, 7), (500, 400)):
        text = rng.integers(0, sigma, n)
        order = sorted(range(n), key=lambda i: text[i:].tolist())
        assert suffix_array(text).tolist() == order
        matrix = WaveletMatrix(text)
        symbol, end = rng.integers(0, sigma, 40), rng.integers(0, n + 1, 40)
        assert matrix.rank(symbol, end)[0].tolist() == [int((text[:e] == s).sum()) for s, e in zip(symbol, end)]


def test_matching_statistics():
    rng = np.random.default_rng(4)
    sequences = [rng.integers(1, 4, n) for n in (30, 1, 25, 40)]
    index = FMIndex(sequences)
    runs = Counter(tuple(s[i:j]) for s in map(list, sequences) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    for k, s in enumerate(map(list, sequences)):
        ends = np.arange(len(s)) + index.starts[k]
        want = [max([0, *(n for n in range(1, min(9, e + 1) + 1) if runs[tuple(s[e + 1 - n : e + 1])] > 1)]) for e in range(len(s))]
        assert index.matching_statistics(ends, 9).tolist() == want


def test_sequences_that_stand_for_several():
    rng = np.random.default_rng(6)
    sequences, weights = [rng.integers(1, 4, n) for n in (20, 15, 30)], [1, 3, 2]
    index, plain = FMIndex(sequences, weights), FMIndex([s for s, w in zip(sequences, weights) for _ in range(w)])
    for k, s in enumerate(sequences):
        ends = np.arange(len(s))
        for least in (2, 3, 5):
            assert index.matching_statistics(ends + index.starts[k], 9, least).tolist() == plain.matching_statistics(ends + plain.starts[sum(weights[:k])], 9, least).tolist()


def noisy(seed, n_docs, window):
    """Texts of few words with shared runs, repeats within a text, copies, white space of all kinds."""
    rng = random.Random(seed)
    shared = [[f"s{rng.randrange(30)}" for _ in range(rng.randint(window - 2, 3 * window))] for _ in range(6)]
    rows = []
    for d in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            words += rng.choice(shared) if kind < 0.4 else [f"u{rng.randrange(10_000)}" for _ in range(rng.randint(1, 40))] if kind < 0.8 else ["it"] * rng.randint(1, 3 * window)
        text = "".join(w + rng.choice([" ", "\n", " \t ", "\r\n", "\x0b"]) for w in words)
        rows.append((d, text))
        if rng.random() < 0.1:
            rows.append((d + 10_000, text))
    return rows


def test_against_brute_force(spark):
    for seed, window, key_words in ((1, 35, 150_000), (2, 10, 150_000), (3, 10, 1), (4, 35, 60)):
        rows = noisy(seed, 60, window)
        check(spark.createDataFrame(rows, DOCS), rows, window=window, key_words=key_words, shard_words=300)


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {d: (n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for (d, _), (n, g, k) in zip(rows, brute([t for _, t in rows]))}
    got = op6_substring_dedup(spark, small).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and any(g for _, g, _ in want.values())


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "x" * 5000), (5, " ".join(f"v{i}" for i in range(40)))]
    check(spark.createDataFrame(rows, DOCS), rows)
    check(spark.createDataFrame([(1, text), (1, text)], DOCS), [(1, text), (1, text)])
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_long_repetitive_text_is_one_interval(spark):
    """A split key's windows are found one by one; a text's row holds them as one interval, not one for each."""
    rows = [(1, "it " * 3000), (2, "own words " + "it " * 2000 + "tail")]
    df = spark.createDataFrame(rows, DOCS)
    spans = {r.did: [tuple(x) for x in r.spans] for r in repeated_intervals(df, key_words=100).collect()}
    assert spans == {1: [(0, 3000)], 2: [(2, 2002)]}
    check(df, rows, key_words=100)


def test_cut_documents(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, f"own  words\n{shared} tail", 9, "a"), (2, f"{shared} other", 9, "b"), (3, shared, 9, "c"), (4, "left  as\nit is", 9, "d"), (5, None, None, "e"), (6, "", 0, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string").selectExpr("*", "1 AS did", "2 AS __th", "'é' AS kept")
    out = cut_documents(df)
    assert out.schema == df.schema
    got = {r.doc_id: (r.text, r.n_chars, r.spans, r.did, r.kept) for r in out.collect()}
    assert got == {1: ("own words tail", 14, "a", 1, "é"), 2: ("other", 5, "b", 1, "é"), 4: ("left  as\nit is", 9, "d", 1, "é"), 5: (None, None, "e", 1, "é"), 6: ("", 0, "f", 1, "é")}
    assert cut_documents(df.limit(0)).count() == 0


def test_keys_whose_contents_share_no_window(spark):
    # In some of these rows the six words in the middle, which other rows have, are the key of the only window, which is nowhere else.
    rows = [(i, " ".join([f"a{i}x{j}" for j in range(15)] + [f"m{i % 100}x{j}" for j in range(6)] + [f"b{i}x{j}" for j in range(14)])) for i in range(1000)]
    check(spark.createDataFrame(rows, DOCS), rows)
