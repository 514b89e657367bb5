import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import treegrain.llm.jaccard as module
from treegrain.llm.graph import connected_components
from treegrain.llm.jaccard import LOOSE, RECALL, THRESHOLD, TREES, Bucket, candidates, keep_one, near_duplicates, overlaps, prefix_depth
from treegrain.llm.queries import op10_ngram_jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def grams(text, n=3):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def brute(rows, threshold=THRESHOLD):
    """[(class_id, n_links)] for rows of (doc_id, text)."""
    sets = [grams(t) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, (1 << 62)), d if d is not None else -(1 << 63))
    return [(None if least[find(i)] == -(1 << 63) else least[find(i)], links[i]) for i in range(len(rows))]


def check(df, rows):
    want = sorted(((d is not None, d or 0), c is not None, c or 0, n) for (d, _), (c, n) in zip(rows, brute(rows)))
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.class_id is not None, r.class_id or 0, r.n_links) for r in near_duplicates(df).collect())
    assert got == want


def family(seed, originals, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = []
    for _ in range(originals):
        base = [word() for _ in range(rng.randint(60, 200))]
        for k in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(0 if rng.random() < 0.2 else rng.randint(0, len(base) // 50)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) * 7, " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_depth_reaches_the_target():
    d = prefix_depth()
    assert d == 4 and 1 - (1 - THRESHOLD**d) ** TREES >= RECALL
    for t in (0.7, 0.9):
        d = prefix_depth(t, 24, 0.985)
        assert 1 - (1 - t**d) ** 24 >= 0.985 > 1 - (1 - t ** (d + 1)) ** 24 or d == 12


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (0, 5, 30, 50, 1)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert overlaps(sets).tolist() == [[n if i != j or len(sets[i]) else 0 for j, n in enumerate(r)] for i, r in enumerate(want)] or all(overlaps(sets)[i][j] == want[i][j] for i in range(5) for j in range(5) if i != j)
    assert overlaps(sets[:2], sets[2:]).tolist() == [r[2:] for r in want[:2]]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {x: find(x) for x in parent}
    assert got == {x: c for x, c in want.items() if x in got} and {x for x in want if x not in got} <= {x for x in want if Counter(want.values())[want[x]] == 1}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    rows = family(8, 25, 12)
    check(spark.createDataFrame(rows, DOCS), rows)


def test_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {d: x for (d, _), x in zip(rows, brute(rows))}
    got = op10_ngram_jaccard(spark, small).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want and any(n for _, n in want.values())


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d"), (1, "A b c d"), (2, None), (3, ""), (4, " \n"), (5, "x"), (5, "x"), (6, "x y"), (7, "lone words stand here")]
    check(spark.createDataFrame(rows, DOCS), rows)
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = keep_one(spark.createDataFrame(rows, DOCS).selectExpr("*", "'q' AS class_id", "1 AS __did", "3 AS th"))
    assert kept.columns == ["doc_id", "text", "class_id", "__did", "th"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 5, 6, 7]
    assert keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_many_copies_of_one_text(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the very same text in a third of all rows', concat('text number ', id, ' is like ', id * 7, ' no other')) AS text")
    out = near_duplicates(df).collect()
    assert {(r.class_id, r.n_links) for r in out if r.doc_id % 3 == 0} == {(0, 999)}
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in out if r.doc_id % 3)


def test_pivots_against_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = rng.integers(0, 256, (6, 64)).astype(np.uint8)
        members = [np.where(rng.random(64) < rng.choice([0.0, 0.3, 0.6, 1.0]), rng.integers(0, 256, 64), base[rng.integers(6)]).astype(np.uint8) for _ in range(80)]
        bucket, parent = Bucket(64), list(range(80))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, m in enumerate(members):
            for a, b in bucket.add(i, m):
                assert find(a) != find(b)  # a forest
                parent[find(a)] = find(b)
        for i in range(80):
            for j in range(i):
                agree = (members[i] == members[j]).mean()
                # What agrees as linked texts do is joined; what joins has a chain of loose agreement.
                assert agree < 0.45 or find(i) == find(j)
        sizes = Counter(map(find, range(80)))
        assert all(any((members[i] == members[j]).mean() >= LOOSE for j in range(80) if j != i) for i in range(80) if sizes[find(i)] > 1)


def test_crowded_bucket_of_strangers(spark):
    """50,000 members of one bucket that have nothing in common but 200 pairs: split until no bucket is crowded, and the pairs still meet."""
    import time

    rng = np.random.default_rng(11)
    n, width = 50_000, 224
    sketches = rng.integers(0, 256, (n, width)).astype(np.uint8)
    for k in range(200):
        same = rng.random(width) < 0.55
        sketches[n - 1 - k, same] = sketches[k, same]
    df = spark.createDataFrame(pd.DataFrame({"nk": np.arange(n), "sketch": [bytes(s) for s in sketches]}), "nk long, sketch binary").repartition(8)
    began = time.perf_counter()
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in candidates(df.selectExpr("1L AS bk", "nk"), df, width).collect()}
    assert len(got & {(k, n - 1 - k) for k in range(200)}) >= 199 and len(got) < 300
    assert time.perf_counter() - began < 300


def test_crowded_bucket_of_a_family(spark, monkeypatch):
    """A family larger than a bucket should be, with a few strangers: one component, and not a copy of its rows for every value that its members share."""
    rng = np.random.default_rng(13)
    n, width = 600, 224
    base = rng.integers(0, 256, width)
    sketches = np.where(rng.random((n, width)) < 0.9, base, rng.integers(0, 256, (n, width))).astype(np.uint8)
    sketches[-20:] = rng.integers(0, 256, (20, width))
    df = spark.createDataFrame(pd.DataFrame({"nk": np.arange(n), "sketch": [bytes(s) for s in sketches]}), "nk long, sketch binary").repartition(4)
    written, spill = [], module.spill_table
    monkeypatch.setattr(module, "spill_table", lambda s, d, label: (back := spill(s, d, label), written.append(back.count()))[0])
    meeting = spark.range(4).selectExpr("id AS bk").crossJoin(df.select("nk"))
    out = connected_components(candidates(meeting, df, width, crowd=100))
    assert {r.component for r in out.collect()} == {0} and out.count() == n - 20
    assert sum(written) < 4 * 4 * n
