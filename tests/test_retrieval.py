"""Retrieval against brute force in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treegrain.functions import text as T
from treegrain.functions.vectors import checked, cosine, letter_counts, normalize
from treegrain.operators import bm25, dense, evaluate, fusion, retrieve
from treegrain.operators.chunks import append, hierarchy_warnings, number, text_list, with_paths
from treegrain.operators.expand import expand


def corpus_of(spark, rows):
    """rows: (path, text)"""
    df = spark.createDataFrame([(i, i, p, t) for i, (p, t) in enumerate(rows)], "id long, pos long, node_path string, text string")
    return with_paths(df).withColumn("embedding", letter_counts(F.col("text")).cast("array<float>"))


def queries_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string").withColumn("embedding", letter_counts(F.col("text")).cast("array<float>"))


def brute_expand(seeds, corpus, parents, children, siblings, cap):
    """seeds: list of rows by rank; corpus: list of (id, path, parent)."""
    out = [(i, "seed", p) for i, p, _ in seeds]
    chosen = {i for i, _, _ in seeds}
    first = lambda test: next((p for _, p, above in seeds if test(p, above)), None)
    groups = {"parent": [], "child": [], "sibling": []}
    for i, path, parent in corpus:
        if i in chosen:
            continue
        for name, on, test in (("parent", parents, lambda p, a: a and path == a), ("child", children, lambda p, a: parent and parent == p), ("sibling", siblings, lambda p, a: parent and a and parent == a)):
            if on and (seed := first(test)) is not None:
                groups[name].append((i, name, seed))
                break
    rest = groups["parent"] + groups["child"] + groups["sibling"]
    return out + rest[: max(0, cap - len(out))]


@pytest.mark.parametrize("bound", [None, 100])
def test_expansion_against_brute_force(spark, bound):
    rng = random.Random(11)
    for trial in range(4):
        paths = []
        for _ in range(80):
            above = rng.choice([""] + paths) if paths else ""
            paths.append((above + "." if above else "") + rng.choice("abcd"))
        corpus = with_paths(spark.createDataFrame([(i, i, p) for i, p in enumerate(paths)], "id long, pos long, node_path string")).cache()
        plain = [(i, p, p.rpartition(".")[0]) for i, p in enumerate(paths)]
        picks = [(q, k, i) for q in range(5) for k, i in enumerate(rng.sample(range(80), 4))]
        seeds = spark.createDataFrame(picks, "query_id long, seed_rank long, id long").join(corpus, "id")
        on = [rng.random() < 0.7 for _ in range(3)]
        cap = rng.choice([2, 6, 50])
        got = expand(seeds, corpus, parents=on[0], children=on[1], siblings=on[2], max_expand=cap, seed_bound=bound).orderBy("query_id", "out_pos").collect()
        for q in range(5):
            own = [plain[i] for qq, _, i in picks if qq == q]
            assert [(r.id, r.relation, r.seed_path) for r in got if r.query_id == q] == brute_expand(own, plain, *on, cap)


def test_expansion_within_documents(spark):
    rows = spark.createDataFrame([(0, 0, 1, "doc"), (1, 1, 1, "doc.a"), (2, 2, 2, "doc"), (3, 3, 2, "doc.a")], "id long, pos long, doc_id long, node_path string")
    corpus = with_paths(rows)
    seeds = corpus.where("id = 1").select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("seed_rank"), "*")
    assert {r.id for r in expand(seeds, corpus).collect()} == {0, 1, 2, 3}
    assert {r.id for r in expand(seeds, corpus, scope="doc_id").collect()} == {0, 1}


def test_query_contract(spark):
    corpus = corpus_of(spark, [("r", "zzz"), ("r.a", "aaa"), ("r.a.x", "bbb"), ("r.b", "aab"), ("s", "ccc"), ("t", "")]).cache()
    q = queries_of(spark, ["a"])
    rows = retrieve.dense_query(corpus, q, 1).orderBy("out_pos").collect()
    assert [(r.id, r.relation, r.seed_path) for r in rows] == [(1, "seed", "r.a"), (0, "parent", "r.a"), (2, "child", "r.a"), (3, "sibling", "r.a")]
    assert rows[0].score > 0.99 and all(math.isnan(r.score) for r in rows[1:])
    assert [r.id for r in retrieve.dense_query(corpus, q, 1, expand_subtree=False).collect()] == [1]
    scored = retrieve.dense_query(corpus, q, 1, rescore=True).orderBy("out_pos").collect()
    assert [r.id for r in scored] == [1, 3, 0, 2] and [r.score for r in scored] == sorted((r.score for r in scored), reverse=True)
    kept = retrieve.dense_query(corpus, q, 1, rescore=True, min_score=0.3).collect()
    assert {r.id for r in kept} == {1, 3}
    assert len(retrieve.dense_query(corpus, q, 3, max_expand=2).collect()) == 3
    with pytest.raises(RuntimeError):
        retrieve.dense_query(corpus.limit(0), q, 1)
    with pytest.warns(UserWarning):
        assert dense.check_size(corpus, 50) == 6
    with pytest.raises(ValueError):
        dense.nearest(corpus, [1.0] * 8, 0)


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 16)).astype(np.float32)
    data[7] = 0
    df = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(data)], "id long, pos long, embedding array<float>").repartition(3)
    unit = data.astype(float) / np.maximum(np.linalg.norm(data.astype(float), axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 6)
    queries = df.where("id < 9").select(F.col("id").alias("query_id"), "embedding")
    for block in (4096, 4):
        got = dense.nearest_batch(df, queries, 6, block=block).orderBy("query_id", "rank").collect()
        for q in range(9):
            want = sorted(range(200), key=lambda i: (-sims[q, i], i))[:6]
            assert [r.id for r in got if r.query_id == q] == want
    one = dense.nearest(df, data[3].tolist(), 6).collect()
    assert [r.id for r in one] == sorted(range(200), key=lambda i: (-sims[3, i], i))[:6]
    assert dense.nearest_batch(df, queries.limit(0), 6).count() == 0
    assert dense.index(df, 16).select(F.max(F.abs(cosine(F.col("embedding"), F.col("embedding")) - 1))).first()[0] <= 1.0
    with pytest.raises(Exception, match="expected 9 dimensions"):
        df.select(checked(F.col("embedding"), 9)).collect()
    with pytest.raises(ValueError):
        checked(F.col("embedding"), 0)
    assert spark.range(1).select(normalize(F.array(F.lit(0.0)))).first()[0] == [0.0]


def test_encode(spark):
    df = spark.createDataFrame([(1, "aab"), (2, None)], "id long, text string")
    out = dense.encode(df, lambda texts: np.array([[len(t), t.count("a")] for t in texts], np.float32)).orderBy("id").collect()
    assert [r.embedding for r in out] == [[3.0, 2.0], [0.0, 0.0]]


def tokens(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c in "abcdefghijklmnopqrstuvwxyz0123456789_":
            word += c
        else:
            out.append(word)
            word = ""
    return [w for w in out if len(w) > 1]


def test_bm25_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["a", "é", "x_y"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "")]
    queries = [(0, "w1 W2 w2 nowhere"), (1, "a ! ?"), (2, "x_y"), (3, None)]
    got = bm25.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), 7).orderBy("query_id", "rank").collect()
    lists = [tokens(t) for _, t in docs]
    n, avg = len(docs), sum(map(len, lists)) / len(docs)
    for q, text in queries:
        scores = {}
        for t in set(tokens(text)):
            df = sum(t in x for x in lists)
            for d, x in enumerate(lists):
                if t in x:
                    tf = x.count(t)
                    scores[d] = scores.get(d, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / avg))
        want = sorted(((-round(s, 6), d) for d, s in scores.items()))[:7]
        assert [(r.doc_id, r.score) for r in got if r.query_id == q] == [(d, -s) for s, d in want]
    assert tuple(bm25.statistics(bm25.documents(spark.createDataFrame([], "doc_id long, text string"))).first()) == (0, 1.0)


def test_fusion_ties_follow_the_first_list(spark):
    shape = "query_id long, id long, rank long"
    first, second = spark.createDataFrame([(0, 1, 0), (0, 2, 1)], shape), spark.createDataFrame([(0, 3, 0), (0, 2, 1), (0, 4, 2)], shape)
    rows = fusion.fuse([first, second], 4).orderBy("rank").collect()
    assert [r.id for r in rows] == [2, 1, 3, 4] and rows[0].rrf == round(2 / 62, 9)


def test_hybrid(spark):
    corpus = corpus_of(spark, [("r", "zz"), ("r.a", "apple apple"), ("r.b", "badge"), ("s", "quince")]).cache()
    q = queries_of(spark, ["quince apple"])
    rows = retrieve.hybrid_query(corpus, q, 2).orderBy("out_pos").collect()
    assert [r.relation for r in rows[:2]] == ["seed", "seed"] and {r.id for r in rows[:2]} == {1, 3}
    assert {(r.id, r.relation) for r in rows[2:]} == {(0, "parent"), (2, "sibling")} and rows[2].rrf is None
    plain = retrieve.hybrid_query(corpus, q, 2, use_hybrid=False).collect()
    assert {r.id for r in plain} == {r.id for r in retrieve.dense_query(corpus, q, 2).collect()}


def test_evaluation(spark):
    corpus = corpus_of(spark, [("m", ""), ("m.a", ""), ("m.ab", ""), ("m.a.x", "")])
    labelled = spark.createDataFrame([(0, ["m.a"]), (1, ["nothing"])], "query_id long, prefixes array<string>")
    results = spark.createDataFrame([(0, 1), (0, 2), (1, 0)], "query_id long, id long")
    rows = {r.query_id: r for r in evaluate.per_query(results, corpus, labelled).collect()}
    assert (rows[0].n_relevant, rows[0].hits, rows[0].recall, rows[0].precision) == (2, 1, 0.5, 0.5)
    assert (rows[1].n_relevant, rows[1].recall) == (1, 0.0)
    report = evaluate.summarize("flat", evaluate.per_query(results, corpus, labelled)).unionByName(spark.createDataFrame([("full", 0.5, 0.5, 2.0)], "condition string, recall double, precision double, avg_result_size double"))
    assert tuple(evaluate.lift(report, "flat", "full").first()) == (0.25, 0.5, 1.0, "better")
    assert spark.sql("SELECT 'x.art15' AS p").select(evaluate.slug_relevant(F.col("p"), F.array(F.lit(1)))).first()[0]


def test_relevant_rows_are_counted_by_prefix(spark):
    corpus = corpus_of(spark, [(f"m.a.x{i}", "") for i in range(1000)] + [("m", ""), ("m.a", ""), ("m.ab", ""), ("m.a.x1.y", ""), (None, "")])
    labels = [(q, ["m.a"]) for q in range(500)] + [(500, ["m.a.x1", "m.a", "m.a", "m"]), (501, ["m.a.x1", "m.ab", None]), (502, []), (503, None), (504, ["m.a.x", ""])]
    labelled = spark.createDataFrame(labels, "query_id long, prefixes array<string>")
    counts = evaluate.relevant_counts(corpus, labelled)
    got = {r.query_id: r.n_relevant for r in counts.collect()}
    assert got == {q: 1002 for q in range(500)} | {500: 1004, 501: 3, 502: 1, 503: 1, 504: 1}
    # No operator gives rows by pairs of query and corpus row (502,000 of them here).
    plan, most = counts._jdf.queryExecution().executedPlan(), 0
    counts.collect()
    work = [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while work:
        node = work.pop()
        work += [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        n = node.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() else 0)
    assert 0 < most < 10_000


def test_numbering_and_append(spark):
    df = spark.range(100).selectExpr("99 - id AS v", "id AS text")
    assert [r.pos for r in number(df, ["v"]).orderBy("v").collect()] == list(range(100))
    one = append(None, spark.createDataFrame([("b", "t", 0, "f", 1, 1), ("a", "t", 0, "f", 1, 1)], "node_path string, text string, depth int, source_file string, start_line int, end_line int"), ["node_path"])
    two = append(one, one.drop("id", "pos", "parent_path", "name"), ["node_path"])
    assert sorted((r.id, r.pos, r.node_path) for r in two.collect()) == [(0, 0, "a"), (1, 1, "b"), (2, 2, "a"), (3, 3, "b")]
    flat = text_list(spark.createDataFrame([(0, "x"), (1, "y")], "i long, text string"), root="note").orderBy("pos").collect()
    assert [(r.node_path, r.parent_path, r.depth) for r in flat] == [("note0", "", 0), ("note1", "", 0)]
    deep = one.withColumn("depth", F.lit(2))
    assert hierarchy_warnings(one).first()[0] is None and "tier" in hierarchy_warnings(deep).first()[0] and hierarchy_warnings(one.limit(0)).first()[0] == "no chunks"


def test_numbers_of_many_rows_are_gapless(spark):
    rows = number(spark.range(0, 200_000, numPartitions=7).selectExpr("(id * 7919) % 200000 AS v", "id AS pad"), ["v"])
    assert tuple(rows.agg(F.count("pos"), F.countDistinct("pos"), F.max("pos") + 1, F.count_if(F.col("pos") == F.col("v"))).first()) == (200_000,) * 4
    assert number(spark.range(3).limit(0), ["id"]).count() == 0


def test_vectors_of_another_length_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<float>").withColumn("pos", F.col("id"))
    queries = df.select(F.col("id").alias("query_id"), "embedding")
    assert [(r.query_id, r.id) for r in dense.nearest_batch(df, queries, 1).orderBy("query_id").collect()] == [(1, 1), (3, 3)]
    with pytest.raises(Exception, match="expected 2 dimensions"):
        dense.nearest_batch(df.unionByName(spark.createDataFrame([(4, [1.0], 4)], "id long, embedding array<float>, pos long")), queries, 1).collect()


def test_candidates_dont_grow_with_the_partitions_of_the_corpus(spark):
    df = spark.range(0, 4000, numPartitions=100).selectExpr("id", "id AS pos", "array(cast(id % 17 AS float), cast(id % 5 + 1 AS float)) AS embedding")
    queries = df.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    found = dense.nearest_batch(df, queries, 3)
    work, most = [found._jdf.queryExecution().executedPlan()], 0
    assert found.count() == 120
    # Forty queries have three rows in each task.
    found.collect()
    work = [work[0].executedPlan() if "AdaptiveSparkPlan" in work[0].nodeName() else work[0]]
    while work:
        node = work.pop()
        work += [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        if "Arrow" in node.nodeName():
            most = node.metrics().get("numOutputRows").get().value() if node.metrics().get("numOutputRows").isDefined() else node.metrics().get("pythonNumRowsReceived").get().value()
    assert 120 <= most <= 120 * 2 * spark.sparkContext.defaultParallelism


def test_a_popular_parent_gives_its_first_children(spark):
    corpus = with_paths(spark.range(20_000).selectExpr("id", "id AS pos", "concat('r.c', id) AS node_path"))
    seeds = corpus.where("id = 15000").select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("seed_rank"), "*")
    assert [r.id for r in expand(seeds, corpus, max_expand=4).orderBy("out_pos").collect()] == [15000, 0, 1, 2]


def test_a_kept_index(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} common" + " w1" * (i % 4)) for i in range(50)] + [(50, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "w1 common"), (1, "w6"), (2, "nothing")], "query_id long, text string")
    kept = bm25.search_index(bm25.build(docs), asked, 5)
    for block in (1024, 1):
        assert sorted(map(tuple, bm25.search(docs, asked, 5, block=block).collect())) == sorted(map(tuple, kept.collect()))


def test_many_query_terms_make_no_row_for_a_pair(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(1, 40)))) for i in range(700)], "doc_id long, text string").repartition(6)
    asked = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text")
    want = sorted(map(tuple, bm25.search_index(bm25.build(docs), asked, 3).collect()))
    monkeypatch.setattr(bm25, "QUERY_TERMS", 500)
    for share in (0.0, 1 / 64, 2.0):
        monkeypatch.setattr(bm25, "HEAD_SHARE", share, raising=False)
        got = bm25.search(docs, asked, 3, block=20)
        assert sorted(map(tuple, got.collect())) == want
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_scalars(spark):
    row = spark.range(1).select(
        T.slug(F.lit("Hello, Wörld!")), T.slug(F.lit("Ñandú É"), fold_accents=True), T.parent_path(F.lit("a.b.c")), T.parent_path(F.lit("a")), T.path_name(F.lit("a.b")), T.article_number(F.lit("Article 12 x")), T.article_number(F.lit("Part 1")),
        T.point_letter(F.lit(2)), T.chapter_title(F.lit("a_bc")), T.numbered_depth(F.lit("1.2.3.4.5")), T.module_name(F.lit("a/b/__init__.py")), T.module_name(F.lit("a/b.py")), T.charset(F.lit('text/html; charset="ISO-8859-1"')), T.charset(F.lit("text/html")), T.main_index(F.lit("u")), T.strip(F.lit(" \n x\t")), F.size(T.tokenize(F.lit("a bc, D_e é1"))),
    ).first()
    assert list(row) == ["hello-w-rld", "nandu-e", "a.b", "", "b", 12, None, "c", "A Bc", 4, "a.b", "a.b", "iso-8859-1", "utf-8", "u_main", "x", 2]
