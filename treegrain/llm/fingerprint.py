"""Merkle fingerprints of documents: a root over section digests over paragraph digests, and hashes of blocks within paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treegrain.llm.textblock import SLICE_BYTES, prefix, raw, span_hashes, tidy
from treegrain.session import ship_code, spread

#: A block ends after a word whose hash falls into one of this many residues, or at the end of its paragraph.
BLOCK_WORDS = 4
#: A section ends after a paragraph whose hash falls into one of this many residues, at an empty line, or before a heading line.
SECTION_PARAGRAPHS = 4
#: Long words count as several, of this many bytes each; a block ends after this many words at the latest (words that repeat choose no place).
PIECE_BYTES, BLOCK_MOST = 8, 8


#: Bytes of a digest of a paragraph or section.
DIGEST = 16
_BLOCK = np.dtype([("hash", ">u4"), ("size", "u1")])
_INNER = np.dtype([("digest", "u1", DIGEST), ("children", ">u4")])


@dataclass
class Trees:
    """The trees of a run of documents, level by level: digests, and how many nodes of the level below each covers (blocks: how many bytes). *_first: where each document's begin."""

    roots: list[str]
    blocks: np.ndarray
    block_first: np.ndarray
    paragraphs: np.ndarray
    paragraph_first: np.ndarray
    sections: np.ndarray
    section_first: np.ndarray


def _digests(tag: bytes, data, bounds: np.ndarray) -> np.ndarray:
    """SHA-256 of each span, cut to DIGEST bytes; the tag keeps levels apart."""
    view, start = memoryview(data), hashlib.sha256(tag)
    out = bytearray()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h = start.copy()
        h.update(view[a:b])
        out += h.digest()[:DIGEST]
    return np.frombuffer(bytes(out), np.uint8).reshape(-1, DIGEST)


def _inner(digests: np.ndarray, children: np.ndarray) -> np.ndarray:
    out = np.empty(len(digests), _INNER)
    out["digest"], out["children"] = digests, children
    return out


def build(data: np.ndarray, offsets: np.ndarray) -> Trees:
    """Trees of all documents in one pass over their bytes. Every byte belongs to a paragraph, white space included.

    A paragraph ends after each newline; its digest is that of its bytes. A section's digest is that of its paragraphs' digests, a root that of its sections'
    digests, so equal roots mean equal texts, and a root commits to every branch below it. Sections group paragraphs: an empty line or a heading (`#`) starts a new
    one, and so does the content of the paragraph before, about every fourth time. Under the paragraphs are blocks of a few words, cut at places
    that the words themselves choose, so an insertion disturbs only the blocks around it; short hashes of them serve to compare and to find places, not to prove.
    """
    n, docs = len(data), len(offsets) - 1
    if n == 0:
        f = np.zeros(docs + 1, np.int64)
        return Trees([hashlib.sha256(b"root").hexdigest()] * docs, np.zeros(0, _BLOCK), f, np.zeros(0, _INNER), f, np.zeros(0, _INNER), f)
    newline, space = data == 10, data == 32
    doc_ends = offsets[1:][np.diff(offsets) > 0]
    paragraph_end = newline.copy()
    paragraph_end[doc_ends - 1] = True
    p_ends = np.flatnonzero(paragraph_end) + 1
    p_starts = np.append(0, p_ends[:-1])
    running = prefix(data)
    word_end = space | paragraph_end
    _every(word_end, PIECE_BYTES)
    w_ends = np.flatnonzero(word_end) + 1
    w_starts = np.append(0, w_ends[:-1])
    w = span_hashes(data, w_starts, w_ends, running)
    cut = (w % np.uint64(BLOCK_WORDS) == 0) | paragraph_end[w_ends - 1]
    _every(cut, BLOCK_MOST)
    b_ends = w_ends[cut]
    b_starts = np.append(0, b_ends[:-1])
    blocks = np.empty(len(b_ends), _BLOCK)
    blocks["hash"], blocks["size"] = span_hashes(data, b_starts, b_ends, running) & np.uint64(0xFFFFFFFF), b_ends - b_starts
    digests = _digests(b"paragraph", np.ascontiguousarray(data), np.append(p_starts, n))
    b_first = np.searchsorted(b_starts, np.append(p_starts, n))
    paragraphs = _inner(digests, np.diff(b_first))
    doc_of_p = np.searchsorted(offsets, p_starts, "right") - 1
    empty = (p_ends - p_starts == 1) & (data[p_starts] == 10)
    starts_section = np.ones(len(p_starts), bool)
    starts_section[1:] = (doc_of_p[1:] != doc_of_p[:-1]) | empty[:-1] & ~empty[1:] | (data[p_starts[1:]] == 35) | (digests[:-1, 0] % SECTION_PARAGRAPHS == 0)
    s_first = np.append(np.flatnonzero(starts_section), len(p_starts))
    sections = _inner(_digests(b"section", digests.tobytes(), s_first * DIGEST), np.diff(s_first))
    of_docs = np.searchsorted(p_starts[s_first[:-1]], offsets)
    above, levels = memoryview(np.ascontiguousarray(sections["digest"]).tobytes()), of_docs * DIGEST
    roots = [hashlib.sha256(b"root" + above[a:b]).hexdigest() for a, b in zip(levels[:-1].tolist(), levels[1:].tolist())]
    return Trees(roots, blocks, np.searchsorted(b_starts, offsets), paragraphs, np.searchsorted(p_starts, offsets), sections, of_docs)


def _every(ends: np.ndarray, most: int) -> None:
    """Add ends so that none is more than `most` places after the one before."""
    at = np.arange(len(ends))
    last = np.maximum.accumulate(np.where(ends, at, -1))
    since = at - np.append(-1, last[:-1])
    ends |= since % most == 0


def encode(trees: Trees, i: int) -> str:
    """The fingerprint of document i: its root, then its sections, paragraphs and blocks in order, each with what it covers, in hexadecimal digits, joined by dots."""
    part = lambda v, f: v[f[i] : f[i + 1]].tobytes().hex()
    return ".".join([trees.roots[i], part(trees.sections, trees.section_first), part(trees.paragraphs, trees.paragraph_first), part(trees.blocks, trees.block_first)])


def decode(fingerprint: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Root, sections, paragraphs, blocks of a fingerprint."""
    root, *levels = fingerprint.split(".")
    return root, *(np.frombuffer(bytes.fromhex(x), kind) for x, kind in zip(levels, (_INNER, _INNER, _BLOCK)))


def verify(fingerprint: str) -> bool:
    """Whether the digests fit together: each section's is that of its paragraphs', and the root that of its sections'."""
    root, sections, paragraphs, blocks = decode(fingerprint)
    bounds = np.append(0, np.cumsum(sections["children"].astype(np.int64)))
    if bounds[-1] != len(paragraphs) or paragraphs["children"].sum() != len(blocks):
        return False
    right = _digests(b"section", np.ascontiguousarray(paragraphs["digest"]).tobytes(), bounds * DIGEST)
    return bool((right == sections["digest"]).all()) and hashlib.sha256(b"root" + right.tobytes()).hexdigest() == root


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two bags."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _alike(root_a: str, a: np.ndarray, root_b: str, b: np.ndarray) -> float:
    if root_a == root_b:
        return 1.0
    both = len(a) + len(b)
    return min(2.0 * _common(a, b) / both, 1.0 - 1e-9) if both else 0.0


def likeness(a: str, b: str) -> float:
    """Share (0 to 1) of the two fingerprints' blocks that they have in common; 1 only if their roots are equal."""
    (ra, *_, xa), (rb, *_, xb) = decode(a), decode(b)
    return _alike(ra, xa["hash"], rb, xb["hash"])


def locate_edits(old: str, new: str) -> list[tuple[int, int]]:
    """Byte spans of the new text that the old one lacks, from the two fingerprints alone: down the branches whose digests the old tree does not have, to blocks.

    What was only deleted or moved leaves no span, unless a block differs because of it.
    """
    (old_root, *before), (new_root, *after) = decode(old), decode(new)
    if old_root == new_root:
        return []
    told = lambda x: set(map(bytes, x["digest"]))
    known_sections, known_paragraphs, known_blocks = told(before[0]), told(before[1]), set(before[2]["hash"].tolist())
    sections, paragraphs, blocks = after
    ends = np.cumsum(blocks["size"].astype(np.int64))
    out, p, k = [], 0, 0
    for section, covers in zip(map(bytes, sections["digest"]), sections["children"].tolist()):
        for q in range(p, p + covers):
            n = int(paragraphs["children"][q])
            if section not in known_sections and bytes(paragraphs["digest"][q]) not in known_paragraphs:
                for i in range(k, k + n):
                    if int(blocks["hash"][i]) not in known_blocks:
                        a, z = int(ends[i]) - int(blocks["size"][i]), int(ends[i])
                        if out and out[-1][1] == a:
                            out[-1] = (out[-1][0], z)
                        else:
                            out.append((a, z))
            k += n
        p += covers
    return out


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint column (null text counts as empty). No shuffle; a column already named `out` is replaced."""
    ship_code(docs.sparkSession)

    def each(s):
        import pandas as pd

        return pd.Series([encode(build(*raw(pa.array([t]))), 0) for t in s.fillna("")])

    return docs.withColumn(out, F.pandas_udf(each, "string")(F.col(f"`{text}`")))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _flush(rows: list[tuple], following: str) -> pa.RecordBatch:
    """rows: (doc_id, text) in order; following: the text after the last."""
    texts = [t for _, t in rows]
    after = texts[1:] + [following]
    edited = []
    for t, nxt in zip(texts, after):
        k = len(t) // 3
        edited.append(t[: len(t) - k] + nxt[:k])
    own, changed = build(*raw(pa.array(texts + [following], pa.large_string()))), build(*raw(pa.array(edited, pa.large_string())))
    cut = lambda t, i: t.blocks["hash"][t.block_first[i] : t.block_first[i + 1]]
    near_e, near_n = [], []
    for i in range(len(rows)):
        mine = cut(own, i)
        near_e.append(_alike(own.roots[i], mine, changed.roots[i], cut(changed, i)))
        near_n.append(_alike(own.roots[i], mine, own.roots[i + 1], cut(own, i + 1)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([encode(own, i) for i in range(len(rows))]),
            pa.array([encode(changed, i) for i in range(len(rows))]),
            pa.array(near_e, pa.float64()),
            pa.array(near_n, pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by bucket and in order; the guest row that ends a bucket only lends its text to the row before it."""
    held: list[tuple] = []
    size, bucket = 0, None
    for batch in batches:
        names = batch.schema.names
        b, ids, texts, guest = (batch.column(names.index(c)) for c in ("__bucket", "doc_id", "text", "__guest"))
        for k in range(batch.num_rows):
            at, i, t, g = b[k].as_py(), ids[k].as_py(), texts[k].as_py() or "", guest[k].as_py()
            if g:
                if held and bucket == at:
                    yield _flush(held, t)
                    held, size = [], 0
                continue
            if size > SLICE_BYTES and bucket == at:
                yield _flush(held, t)
                held, size = [], 0
            bucket = at
            held.append((i, t))
            size += len(t)
    if held:
        raise ValueError("a bucket without its guest row")


def edit_test(docs: DataFrame, *, rows_per_bucket: int = 5000) -> DataFrame:
    """Fingerprint every document and its edited text (its last third replaced by the start of the next document's).

    The next document is the next smaller doc_id (null: smallest of all); equal ids follow in the order of a hash of their text;
    the last document is followed by the first, a single document by itself. Null text counts as empty. Repeated rows stay apart.
    An empty table gives no rows.

    The order is made without a single sorting task: ids (no texts) are sorted into ranges, the number and first key of each range
    (one small row per range) go to the driver, and one shuffle brings each text to its range, with one extra row per range, the head
    of the next one. Ranges stream through Python, so neither memory nor the driver depends on how many rows a range holds.
    """
    spark = docs.sparkSession
    ship_code(spark)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("__k", F.coalesce(-F.col("doc_id").cast("decimal(20,0)"), F.lit("99999999999999999999").cast("decimal(20,0)"))).withColumn("__h", F.xxhash64("text"))
    thin = keyed.select("__k", "__h")
    n = thin.count()
    if n == 0:
        return spark.createDataFrame([], RESULT)
    parts = max(1, min(-(-n // rows_per_bucket), 1 << 16))
    if parts < spark.sparkContext.defaultParallelism:
        parts = min(n, spark.sparkContext.defaultParallelism)
    cuts = thin.repartitionByRange(parts, "__k", "__h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("__k", "__h")).alias("head")).select("head.*").distinct().collect()
    heads = sorted({(int(r["__k"]), int(r["__h"])) for r in cuts})
    joint = spark.sparkContext.broadcast(heads)

    def bucket_of(k, h):
        import bisect

        import pandas as pd

        return pd.Series([bisect.bisect_right(joint.value, (int(a), int(b))) - 1 for a, b in zip(k, h)], dtype="int32")

    placed = keyed.withColumn("__bucket", F.pandas_udf(bucket_of, "int")("__k", "__h"))
    # A head is the first row of its bucket; its copy ends the bucket before it, and the first bucket's head ends the last bucket.
    head_rows = spark.createDataFrame([(str(k), h, (i - 1) % len(heads)) for i, (k, h) in enumerate(heads)], "k string, h long, before int")
    head_rows = head_rows.select(F.col("k").cast("decimal(20,0)").alias("__k"), F.col("h").alias("__h"), "before")
    guests = keyed.join(F.broadcast(head_rows), ["__k", "__h"]).groupBy("before").agg(F.first("text").alias("text"))
    rows = placed.select("__bucket", "__k", "__h", "doc_id", "text", F.lit(False).alias("__guest")).unionByName(
        guests.select(F.col("before").alias("__bucket"), F.lit(None).cast("decimal(20,0)").alias("__k"), F.lit(None).cast("long").alias("__h"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("__guest"))
    )
    ordered = rows.repartition(len(heads), "__bucket").sortWithinPartitions("__bucket", "__guest", "__k", "__h")
    return ordered.select("__bucket", "doc_id", "text", "__guest").mapInArrow(tidy(_pairs), RESULT)
