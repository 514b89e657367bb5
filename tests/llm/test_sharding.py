import hashlib
import math
from collections import Counter, defaultdict

from treegrain.llm.queries import op1_rendezvous_sharding
from treegrain.llm.sharding import assign_shards, number_slots, shard_documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def expected(key, weights, salt="treegrain"):
    def score(k, w):
        u = (int(hashlib.md5(f"{salt}:{k}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -w / math.log(u)

    return max((k for k, w in enumerate(weights) if w), key=lambda k: (score(k, weights[k]), -k))


def check(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_query_against_brute_force(spark, small):
    rows = op1_rendezvous_sharding(spark, small).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    import zlib

    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == expected(r.doc_id, [1] * 8) and r.grown_shard == expected(r.doc_id, [1] * 9)
    check(rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a", None, None, None), (1, "a", None, None, None), (1, None, "x", None, 3), (None, "", None, None, None), (None, None, None, None, None), (2, "é", None, None, None)]
    out = shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 6
    check(out)
    assert len({r.shard for r in out if r.doc_id == 1}) == 1
    assert {(r.size, r.text_crc32) for r in out if r.doc_id is None} == {(1, 0)}
    assert [r.size for r in out if r.doc_id == 2] == [3]
    assert shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_weights_and_minimal_movement(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'mine' AS shard", "1 AS Score")
    out = assign_shards(keys, "doc_id", [1, 2, 1], grown=[1, 3, 1]).collect()
    share = Counter(r.shard for r in out)
    assert abs(share[1] / 4000 - 0.5) < 0.05 and abs(share[0] / 4000 - 0.25) < 0.05
    assert all(r.grown_shard == r.shard or r.grown_shard == 1 for r in out)
    assert all(r.shard == expected(r.doc_id, [1, 2, 1], "") for r in out[:200])
    gone = assign_shards(keys, "doc_id", [1, 2, 1], grown=[1, 2, 0]).collect()
    assert all(r.grown_shard == r.shard or r.shard == 2 for r in gone)


def test_a_hot_key_is_one_row_of_the_shuffle(spark):
    hot = spark.range(3000).selectExpr("CAST(5 AS LONG) AS doc_id", "'same' AS text", "'l' AS lang", "'s' AS source", "id * 0 AS n_chars")
    out = shard_documents(hot).collect()
    assert sorted(r.slot for r in out) == list(range(3000))
    few = number_slots(spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "shard int, doc_id long"), buckets=1).collect()
    assert sorted((r.shard, r.slot, r.doc_id) for r in few) == [(0, 0, 1), (0, 1, 2), (1, 0, 3)]


def test_a_hot_row_is_cut_into_runs(spark):
    n = 300_000
    hot = spark.range(n).selectExpr("5L AS doc_id", "'x' AS text").unionByName(spark.range(100).selectExpr("id AS doc_id", "'y' AS text"))
    slotted = number_slots(assign_shards(hot.selectExpr("doc_id", "length(text) AS size"), "doc_id", [1.0, 1.0]))
    got = slotted.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == n + 100 and all(r["max(slot)"] + 1 == r["count(1)"] for r in got)
    assert slotted.select("shard", "slot").distinct().count() == n + 100
