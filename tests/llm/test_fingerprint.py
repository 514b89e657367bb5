import hashlib
import random

import pyarrow as pa

from treegrain.llm.fingerprint import build, decode, edit_test, encode, fingerprint, likeness, locate_edits, verify
from treegrain.llm.queries import op2_merkle_fingerprints
from treegrain.llm.textblock import raw

DOCS = "doc_id long, text string"


def of(text):
    return encode(build(*raw(pa.array([text]))), 0)


def edited(text, following):
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def check(rows, docs):
    order = sorted(docs, reverse=True)
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for i, d in enumerate(order):
        r, following = by[d], docs[order[(i + 1) % len(order)]]
        new = edited(docs[d], following)
        assert r.n_chars == len(docs[d])
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == of(docs[d]) and r.edited_fingerprint == of(new)
        assert r.near_edited == likeness(of(docs[d]), of(new)) and r.near_next == likeness(of(docs[d]), of(following))


def test_query_against_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op2_merkle_fingerprints(spark, small).collect()
    check(rows, docs)
    assert sum(r.near_edited for r in rows) / len(rows) > 0.6 and sum(r.near_next for r in rows) / len(rows) < 0.1


def test_ranges_of_any_size_give_the_same(spark):
    docs = {i: f"Text {i} é.\nwith lines\n" * (i % 5) for i in range(-7, 40)}
    df = spark.createDataFrame(list(docs.items()), DOCS)
    for size in (1, 5, 1000):
        check(edit_test(df, rows_per_bucket=size).collect(), docs)


def test_nulls_repeats_and_empty(spark):
    assert edit_test(spark.createDataFrame([], DOCS)).count() == 0
    (r,) = edit_test(spark.createDataFrame([(3, "abcdef")], DOCS)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0
    out = edit_test(spark.createDataFrame([(3, None), (None, "abc"), (None, "abc"), (3, ""), (4, "xyz" * 50)], DOCS)).collect()
    assert len(out) == 5 and sorted(r.n_chars for r in out) == [0, 0, 3, 3, 150]
    assert len({r.fingerprint for r in out if not r.n_chars}) == 1
    assert of("") != of(" ") and likeness(of(""), of("")) == 1 and likeness(of(""), of("a")) == 0


def test_roots_sections_and_edits():
    random.seed(3)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]
    text = "\n".join(" ".join(random.choice(words) + str(random.randrange(99)) for _ in range(40)) for _ in range(30))
    at = text.index("\n", 3000) + 5
    new = text[:at] + "INSERTED" + text[at:]
    spans = locate_edits(of(text), of(new))
    assert spans and all(abs(a - at) < 300 and abs(b - at) < 300 for a, b in spans) and any(a <= at < b for a, b in spans)
    assert locate_edits(of(text), of(text)) == []
    assert 0.9 < likeness(of(text), of(new)) < 1
    assert of(text) == of(text) and of(text).split(".")[0] != of(new).split(".")[0]
    assert likeness(of("a b"), of("a  b")) < 1


def test_the_root_commits_to_every_branch():
    text = "# One\nalpha beta gamma\ndelta é\n\n# Two\n" + "word " * 300 + "\nlast line"
    root, sections, paragraphs, blocks = decode(of(text))
    assert verify(of(text)) and verify(of("")) and verify(of("x"))
    # Paragraphs by hand: the digests below the root are those of the text's lines.
    lines = [x.encode() for x in text.splitlines(keepends=True)]
    assert [bytes(p) for p in paragraphs["digest"]] == [hashlib.sha256(b"paragraph" + x).digest()[:16] for x in lines]
    at, above = 0, b""
    for s in sections:
        own = b"".join(bytes(p) for p in paragraphs["digest"][at : at + s["children"]])
        assert bytes(s["digest"]) == hashlib.sha256(b"section" + own).digest()[:16]
        above, at = above + bytes(s["digest"]), at + int(s["children"])
    assert root == hashlib.sha256(b"root" + above).hexdigest() and at == len(lines)
    assert int(blocks["size"].sum()) == len(text.encode())
    # A digit changed in any section or paragraph digest doesn't go unnoticed.
    parts = of(text).split(".")
    for level, width in ((1, 40), (2, 40)):
        for k in range(0, len(parts[level]), width):
            forged = list(parts)
            forged[level] = parts[level][:k] + ("1" if parts[level][k] != "1" else "2") + parts[level][k + 1 :]
            assert not verify(".".join(forged))


def test_edits_are_located_without_the_texts():
    rng = random.Random(9)
    for _ in range(40):
        lines = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 40))]
        k = rng.randrange(len(lines))
        changed = [*lines[:k], lines[k] + " entirely new words here", *lines[k + 1 :]]
        old, new = "\n".join(lines), "\n".join(changed)
        at = len("\n".join(changed[: k + 1]).encode()) - len(" entirely new words here")
        spans = locate_edits(of(old), of(new))
        assert any(a <= at + 5 < b for a, b in spans) and all(a >= at - 100 and b <= at + 200 for a, b in spans)


def test_very_long_text():
    text = "".join(f"line {i} of a very long text\n" for i in range(60_000)) + "x" * 1_000_000
    assert verify(of(text)) and 0.99 < likeness(of(text), of(text + "y")) < 1


def test_column(spark):
    rows = fingerprint(spark.createDataFrame([(1, "x y", "old"), (2, None, "old")], "doc_id long, text string, fingerprint string")).collect()
    assert [r.fingerprint for r in rows] == [of("x y"), of("")]
