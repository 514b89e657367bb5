"""Sources, summaries, service rules and streams."""

import base64
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from treegrain.functions.text import chunk_key
from treegrain.operators import service, summaries
from treegrain.operators.bm25 import documents, term_frequencies
from treegrain.operators.chunk_text import chunk_text
from treegrain.operators.chunks import CHUNK
from treegrain.sources import readers, sinks
from treegrain.streaming import live


@pytest.mark.parametrize("text, kind", [("https://x.org/a", "url"), ("HTTP://x", "url"), ("see https://x", "text"), ("<div class=a>x", "html"), ("<p>x", "text"), ("intro\n## Head", "markdown"), ("#nospace", "text"), ("", "text"), ("plain", "text")])
def test_sniff(spark, text, kind):
    assert spark.range(1).select(readers.sniff_kind(F.lit(text))).first()[0] == kind


def test_sniff_paths_and_fetched_kinds(spark):
    exists = F.lit(True)
    got = spark.createDataFrame([("a.txt",), ("a\nb",), ("# x",), ("",)], "s string").select(readers.sniff_kind(F.col("s"), exists=exists).alias("k")).collect()
    assert [r.k for r in got] == ["path", "text", "markdown", "text"]
    rows = [("u/a.pdf?x=1", None, ""), ("u", "application/pdf", ""), ("u/b.MD", None, ""), ("u", "text/markdown", ""), ("u", "text/plain", "words"), ("u", "text/plain", "<html>"), ("u", None, "words")]
    got = spark.createDataFrame(rows, "u string, c string, b string").select(readers.fetched_kind(F.col("u"), F.col("c"), F.col("b")).alias("k")).collect()
    assert [r.k for r in got] == ["pdf", "pdf", "markdown", "markdown", "text", "html", "html"]


def test_text_chunks(spark):
    def chunks(text, **options):
        rows = chunk_text(spark.createDataFrame([(0, text)], "doc_id long, text string"), **options).orderBy("local_id").collect()
        assert [r.node_path for r in rows] == ["doc"] + [f"doc.p{i}" for i in range(1, len(rows))] and rows[0].text == "doc\nDocument"
        return [r.text.split("\n\n", 1)[1] for r in rows[1:]]

    assert chunks(None) == [] and chunks(" \n\n ") == []
    assert chunks("short") == ["short"]
    assert chunks("a" * 50 + "\n\nb\n\nc") == ["a" * 50 + "\n\nb\n\nc"]
    assert chunks("a\n \nb" + "b" * 50 + "\n\n" + "c" * 40) == ["a\n\nb" + "b" * 50, "c" * 40]
    sentences = ["Sentence number one is here.", "Another follows it!", "Is this the third? yes it is.", "Last."]
    assert chunks(" ".join(sentences), max_chars=50) == ["Sentence number one is here. Another follows it!", "Is this the third? yes it is. Last."]
    assert chunks("X" * 80 + ". Next one.", max_chars=50) == ["X" * 80 + ".", "Next one."]


def write(root, name, content):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(content)


def test_directory(spark, tmp_path):
    write(tmp_path, "b/note.md", "# Title\nbody")
    write(tmp_path, "a/__init__.py", "'''Pkg.'''\n")
    write(tmp_path, "a/mod.py", "def f():\n    return 1\n")
    write(tmp_path, "c.html", "<h1>Page</h1>")
    write(tmp_path, "skip.bin", "x")
    write(tmp_path, "tests/t.py", "x = 1\n")
    rows = readers.directory(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.node_path for r in rows] == ["a", "a.mod", "a.mod.f", "doc", "doc.title", "doc", "doc.page", "tests.t"]
    assert [r.id for r in rows] == list(range(8)) and {f for f in rows[0].asDict()} >= set(CHUNK.names)
    assert [r.node_path for r in readers.directory(spark, str(tmp_path), qualified=False, exclude=("tests",)).orderBy("pos").collect()][:2] == ["__init__", "mod"]
    assert [r.node_path for r in readers.chunks_from_source(spark, tmp_path / "a" / "mod.py").orderBy("pos").collect()] == ["mod", "mod.f"]


def test_sources(spark, tmp_path):
    one = lambda s: [r.node_path for r in readers.chunks_from_source(spark, s).orderBy("pos").collect()]
    assert one(["x", "y"]) == ["text0", "text1"] and one("<h1>A</h1><h2>B</h2>") == ["doc", "doc.a", "doc.a.b"] and one("# A") == ["doc", "doc.a"] and one("words") == ["doc", "doc.p1"] and one("") == ["doc"]
    with pytest.raises(TypeError):
        readers.chunks_from_source(spark, 5)
    with pytest.raises(ValueError):
        readers.chunks_from_source(spark, "https://example.org")
    (tmp_path / "d.json").write_text('{"text": "t", "node_path": "b.c", "depth": 1}\n{"text": "u", "node_path": "a"}\n')
    rows = readers.json_documents(spark, str(tmp_path / "d.json")).orderBy("pos").collect()
    assert [(r.node_path, r.depth, r.source_file, r.parent_path) for r in rows] == [("a", 0, "<inline>", ""), ("b.c", 1, "<inline>", "b")]
    with pytest.raises(ValueError):
        readers.given_chunks(spark.createDataFrame([("x",)], "text string"))
    with pytest.raises(Exception, match="no parser"):
        readers.dispatch(spark.createDataFrame([(0, "odd", "x")], "doc_id long, kind string, content string")).collect()
    mixed = readers.dispatch(spark.createDataFrame([(0, "markdown", f"# A\n- {'x' * 10}"), (1, "html", "<h1>B</h1>"), (2, "pdf", "Chapter 1 C\fpage two")], "doc_id long, kind string, content string"), options={"markdown": {"min_chars": 5}})
    assert {r.node_path for r in mixed.collect()} == {"doc", "doc.a", "doc.a.li1", "doc.b", "doc.chapter-1-c"}


def archive(kind, members):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            for n, c in members.items():
                z.writestr(n, c)
    else:
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for n, c in members.items():
                info = tarfile.TarInfo(n)
                info.size = len(c)
                t.addfile(info, io.BytesIO(c.encode()))
    return base64.b64encode(out.getvalue()).decode()


def test_archives(spark):
    shape = "archive_id long, archive_b64 string, archive_format string"
    good = {"pkg/__init__.py": "", "pkg/m.py": "def f(): pass\n", "readme.md": "# R", "data.bin": "x"}
    df = spark.createDataFrame([(1, archive("zip", good), "zip"), (2, archive("tar.gz", good), "tar.gz")], shape)
    rows = readers.index_archive(df, max_bytes=1 << 20).orderBy("pos").collect()
    assert [r.node_path for r in rows] == ["pkg", "pkg.m", "pkg.m.f", "doc", "doc.r"] * 2
    for members, kind, limit, message in (({"../x.py": ""}, "zip", 1 << 20, "unsafe"), ({"/x.py": ""}, "tar.gz", 1 << 20, "unsafe"), (good, "rar", 1 << 20, "unknown"), (good, "zip", 10, "allowed")):
        bad = spark.createDataFrame([(1, archive("zip" if kind == "rar" else kind, members), kind)], shape)
        with pytest.raises(Exception, match=message):
            readers.archives(bad, max_bytes=limit).collect()


def test_index_files(spark, tmp_path):
    tf = term_frequencies(documents(spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc")], "doc_id long, text string")))
    sinks.write_postings(tf, str(tmp_path / "p"), buckets=4)
    assert {(r.doc_id, r.tf) for r in sinks.read_postings(spark, str(tmp_path / "p"), ["aa"], buckets=4).collect()} == {(1, 2)}
    sinks.append_index(tf, str(tmp_path / "i"))
    sinks.append_index(tf, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 8
    sinks.reset_index(tf, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 0


def test_summaries(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "text a"), ("b", "text b")], "node_path string, text string")
    key = chunks.where("node_path = 'a'").select(chunk_key(F.col("node_path"), F.col("text"))).first()[0]
    import hashlib

    assert key == hashlib.sha256(b"a|text a").hexdigest()[:16]
    (tmp_path / "c.json").write_text(json.dumps({"model": "m", "generated_at": "now", "n_summaries": 1, "summaries": {key: "sum a"}}, indent=1))
    cache = summaries.load_cache(spark, str(tmp_path / "c.json"))
    assert [r.node_path for r in summaries.todo(chunks, cache).collect()] == ["b"]
    made = summaries.generate(chunks, cache, lambda prompts: [p.split("Path: ")[1][:1] + "!" for p in prompts])
    assert [r.summary for r in made.collect()] == ["b!"]
    assert {r.text for r in summaries.apply(chunks, cache.unionByName(made)).collect()} == {"a\nsum a", "b\nb!"}
    summaries.save_cache(cache, str(tmp_path / "out"))
    assert summaries.load_cache(spark, str(tmp_path / "out")).collect() == cache.collect()
    asked = []
    note = lambda prompts: [asked.append(p) or "s" for p in prompts]
    assert [summaries.resume(chunks, str(tmp_path / "kept"), note, every=1) for _ in range(2)] == [2, 0]
    assert summaries.load_cache(spark, str(tmp_path / "kept")).count() == 2


def test_service_rules(spark):
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    row = spark.range(1).select(service.expires_at(ts, F.lit(60)).cast("string"), service.expires_at(ts, F.lit(0))).first()
    assert list(row) == ["2024-01-01 00:01:00", None]
    indexes = spark.createDataFrame([("a", "u", "2024-01-01 00:01:00"), ("b", "u", None)], "index_id string, owner string, e string").select("index_id", "owner", F.col("e").cast("timestamp").alias("expires_at"))
    at = lambda s: {r.index_id for r in service.live(indexes, F.lit(s).cast("timestamp")).collect()}
    assert at("2024-01-01 00:01:00") == {"a", "b"} and at("2024-01-01 00:01:01") == {"b"}
    assert service.put(indexes, indexes.limit(1)).count() == 2 and service.drop(indexes, "a").count() == 1
    free = {"max_vectors": 10, "max_archive_bytes": 100}
    assert service.over_limits(10, 100, free) is None and "vectors" in service.over_limits(11, 1, free) and "bytes" in service.over_limits(1, 101, free)
    for q, k in (("", 1), ("x" * 2001, 1), ("x", 0), ("x", 51)):
        with pytest.raises(ValueError):
            service.check_request(q, k)
    service.check_request("x", 50)
    users = spark.createDataFrame([("u", "free"), ("v", "paid")], "user_id string, tier string")
    asked = spark.createDataFrame([(i, "u", "a", f"2024-01-01 00:00:{i % 60:02d}") for i in range(51)] + [(60, "u", "zz", "2024-01-02 00:00:00"), (61, "v", "b", "2024-01-02 00:00:00")], "request_id long, user_id string, index_id string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.request_id: r.status for r in service.search(asked, indexes, users, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()}
    assert got[60] == 404 and got[61] == 403 and sorted(got.values()).count(429) == 1 and sorted(got.values()).count(200) == 50
    changed = service.tier_changes(users, spark.createDataFrame([("u", 1, "created"), ("u", 2, "other"), ("v", 1, "created"), ("v", 2, "paused")], "user_id string, seq long, kind string"))
    assert {(r.user_id, r.tier) for r in changed.collect()} == {("u", "paid"), ("v", "free")}


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    docs = spark.createDataFrame([(1, "aa bb"), (2, "bb cc")], "doc_id long, text string")
    docs.write.parquet(source)
    read = lambda: spark.readStream.schema(docs.schema).parquet(source)
    for _ in range(2):
        live.ingest(read(), chunk_text, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).count() == 4
    docs.withColumn("doc_id", F.col("doc_id") + 2).write.mode("append").parquet(source)
    live.ingest(read(), chunk_text, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).select("doc_id").distinct().count() == 4
    q = live.term_statistics(read()).writeStream.outputMode("complete").format("memory").queryName("df_table").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.term, r.df) for r in spark.table("df_table").collect()} == {("aa", 2), ("bb", 4), ("cc", 2)}
    chunks = docs.select(F.col("doc_id").cast("string").alias("node_path"), "text")
    chunks.write.parquet(str(tmp_path / "chunks"))
    for _ in range(2):
        live.summarize(spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "chunks")), lambda p: ["s"] * len(p), str(tmp_path / "cache"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_response_texts_are_cut_before_they_meet_the_results(spark):
    corpus = spark.createDataFrame([(1, "d1", 0, "abc" * 1000, "s")], "id long, node_path string, depth int, text string, source_file string")
    rows = service.search_rows(spark.createDataFrame([(7, 1, 0)], "query_id long, id long, out_pos long"), corpus, characters=4)
    assert [tuple(r) for r in rows.collect()] == [(7, 0, "d1", 0, "abca", "s")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("substring(")
