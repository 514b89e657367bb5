import math
import random
from collections import Counter

from treegrain.llm.decontaminate import B, K1, BlockMaxIndex, Statistics, contaminated, drop_contaminated, split_item, tokens, word_hash
from treegrain.llm.queries import op3_decontamination

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"


def index_of(items):
    return BlockMaxIndex(items, Statistics(len(items), sum(map(len, items)) / len(items), Counter(t for x in items for t in set(x))))


def brute_scores(items, terms):
    n, mean, df = len(items), sum(map(len, items)) / len(items), Counter(t for x in items for t in set(x))
    out = {}
    for d, words in enumerate(items):
        w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for t, c in Counter(words).items()}
        out[d] = sum(x for t, x in w.items() if t in terms) / sum(w.values())
    return out


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[vocabulary[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(3, 25))] for _ in range(120)]
    index = index_of(items)
    for k in range(150):
        terms = {vocabulary[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(1, 25))}
        for threshold in (0.2, 0.5, 0.8):
            want = {d: s for d, s in brute_scores(items, terms).items() if s >= threshold}
            got = dict(index.search(terms, threshold))
            assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)
            # The bound over all passages lets no such query go.
            import numpy as np

            words = sorted(terms)
            kept = index.promising(word_hash(words), np.array([0]), np.array([len(words)]), threshold)
            assert len(kept) or not want


def planted(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(60)]
    docs = []
    for d in range(120):
        text = [word() for _ in range(rng.randint(0, 700))]
        if d % 3 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = (items[d // 3][1].upper() if d % 2 else items[d // 3][1].replace(" ", "\n")).split(" ")
        docs.append((d, " ".join(text)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)


def test_planted_items_whole_and_in_parts(spark):
    docs, items = planted(spark)
    want = {(d, d // 3) for d in range(0, 120, 3)}
    for limit in (1 << 20, 2000):
        assert {(r.doc_id, r.item_id) for r in contaminated(docs, items, index_bytes=limit).collect()} == want
    left = drop_contaminated(docs.selectExpr("doc_id", "text", "1 AS __did", "2 AS th"), items)
    assert left.columns == ["doc_id", "text", "__did", "th"] and {r.doc_id for r in left.collect()} == {d for d in range(120) if d % 3}


def test_query_against_containment(spark, medium):
    items = [(r.item_id, tokens(r.text)) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    docs = {r.doc_id: " ".join(tokens(r.text)) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, words in items if " ".join(words) in t}
    got = {(r.doc_id, r.item_id) for r in op3_decontamination(spark, medium).collect()}
    assert want and want <= got and len(got - want) <= 0.02 * len(want)


def test_items_of_any_length_at_once(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    items = [(n, " ".join(word() for _ in range(n))) for n in (1, 2, 3, 4, 5, 8, 40, 200, 3000)]
    docs = [(n, " ".join([word() for _ in range(90)] + text.split() + [word() for _ in range(90)])) for n, text in items]
    # The same words in another order hold no short item.
    docs += [(-n, " ".join([word() for _ in range(30)] + [f"{w} {word()}" for w in reversed(text.split())])) for n, text in items if 1 < n < 5]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(n, n) for n, _ in items}


def test_question_alone_is_not_enough(spark):
    text = "what is the capital of the far away island state of lorem it is the old town of ipsum dolor by the sea"
    question, answer, _ = split_item(text)
    docs = spark.createDataFrame([(1, " ".join(question)), (2, text), (3, " ".join(question) + " and then something else happened to everyone there")], DOCS)
    items = spark.createDataFrame([(7, text)], ITEMS)
    assert {r.doc_id for r in contaminated(docs, items, retrieve=0.4).collect()} == {2}
    own = spark.createDataFrame([(7, " ".join(question), "ipsum dolor by the sea")], "item_id long, text string, answer string")
    assert split_item("q w", "a")[:2] == (["q", "w"], ["a"]) and split_item("q w") == (["q", "w"], [], 5)
    assert {r.doc_id for r in contaminated(docs, own).collect()} == {2}


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six")], DOCS)
    items = spark.createDataFrame([(1, "One two three four five six"), (1, "One two three four five six"), (2, None), (3, ""), (4, "x")], ITEMS)
    assert sorted((r.doc_id or 0, r.item_id) for r in contaminated(docs, items).collect()) == [(0, 1), (3, 1), (3, 1)]
    assert sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == [1, 2]
    assert contaminated(docs, items.limit(0)).count() == 0 and contaminated(docs.limit(0), items).count() == 0
    long = spark.createDataFrame([(1, "filler " * 30_000 + "one two three four five six" + " filler" * 1000)], DOCS)
    assert contaminated(long, items).count() == 1
