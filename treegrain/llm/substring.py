"""Removal of word sequences that occur more than once in a corpus, by FM-indexes over shards that hold all places of any such sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from treegrain.llm.fmindex import FMIndex
from treegrain.llm.textblock import SLICE_BYTES, Words, ngram_hashes, raw, sequence_hashes, signed, slices, sliding_min, tidy, word_prefix
from treegrain.session import discard, fresh_names, ship_code, spill_table, spread

WINDOW = 35
#: Words of the n-grams among which each window's smallest hash, its key, is found; the longer ones split keys that have too much under them.
ANCHORS = (6, 12, 24)
#: Words that one FM-index holds at least, if its partition has so many (a key's segments stay together).
SHARD_WORDS = 150_000
#: Distinct words under one key that an index takes; a key with more is split.
KEY_WORDS = 150_000
_NULL = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """did, th, text: the row's key without nulls, and its text (null: none)."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("did"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))


SEGMENTS = "key long, content long, a long, b long, place long, inner boolean, n long"
_START_BITS = 31
_LENGTH = (1 << _START_BITS) - 1


def _segments(window: int, anchor: int):
    """Maximal runs of windows of one text with the same key; with anchors as long as windows, single windows. Equal windows have equal keys, wherever they are."""
    span = window - anchor + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for part in slices(batch):
                w = Words(*raw(part.column(names.index("text"))))
                if len(w) < window:
                    continue
                h = w.hashes()
                grams = ngram_hashes(h, anchor)
                keys = sliding_min(grams, span)
                valid = w.doc[: len(keys)] == w.doc[window - 1 :]
                change = np.ones(len(keys), bool)
                if span > 1:
                    change[1:] = (keys[1:] != keys[:-1]) | (w.doc[1 : len(keys)] != w.doc[: len(keys) - 1]) | ~valid[:-1]
                starts = np.flatnonzero(change & valid)
                if not len(starts):
                    continue
                stops = np.append(np.flatnonzero(change | ~valid), len(keys))
                last = stops[np.searchsorted(stops, starts, "right")] - 1
                ends = last + window
                key = keys[starts]
                # A segment can hold a window twice only if its key's n-gram is at two places.
                n = ends - anchor + 1 - starts
                at = np.repeat(starts - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                hits = np.add.reduceat((grams[at] == np.repeat(key, n)).astype(np.int32), np.append(0, np.cumsum(n)[:-1]))
                doc = w.doc[starts]
                content = sequence_hashes(word_prefix(h), starts, ends)
                place = (starts - w.first[doc]) << _START_BITS | (ends - starts)
                column = lambda c: pa.array(part.column(names.index(c)).to_numpy()[doc])
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(content)), column("a"), column("b"), pa.array(place), pa.array(hits > 1), column("n")], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return each


CONTENTS = "key long, content long, n long, words binary, way int"


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted segment, joined by one space. Of equal texts that follow each other the first answers."""
    before = None
    for batch in batches:
        out = []
        a, b, texts, wanted = (batch.column(batch.schema.names.index(c)) for c in ("a", "b", "text", "wanted"))
        for i, key in enumerate(zip(a.to_pylist(), b.to_pylist())):
            if key == before:
                continue
            before = key
            data, at = raw(texts.slice(i, 1))
            w, data = Words(data, at), data.tobytes()
            for s in wanted[i].as_py():
                start, n = s["place"] >> _START_BITS, s["place"] & _LENGTH
                out.append((s["key"], s["content"], s["n"], b" ".join(data[w.starts[k] : w.ends[k]] for k in range(start, start + n)), s["way"]))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in CONTENTS.split(", ")])


#: What becomes of a content: its key has no other; it has; it has too much under it.
ALONE, MANY, LARGE = 0, 1, 2
MATCHES = "key long, content long, s long, e long"


def _search(window: int, shard_words: int):
    """Index the distinct segments of a shard, each with the number of its places, and stream them through: where at least a window matches that has another place too.

    Rows come sorted by key and content, or each with a key of its own.
    """

    def shard(rows: list[tuple]) -> list[tuple]:
        names: dict[bytes, int] = {}
        sequences = [np.array([names.setdefault(x, len(names) + 1) for x in r[3].split(b" ")], np.int64) for r in rows]
        index = FMIndex(sequences, [r[2] for r in rows])
        lengths = np.array([len(s) for s in sequences])
        n = lengths - window + 1
        of = np.repeat(np.arange(len(rows)), n)
        first = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
        found = index.matching_statistics(index.starts[of] + first + window - 1, window) >= window
        of, first = of[found], first[found]
        if not len(of):
            return []  # contents that share their key's n-gram and no window
        # Windows that follow each other or overlap are one interval.
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (first[1:] > first[:-1] + window)
        last = np.append(np.flatnonzero(new)[1:], len(of)) - 1
        return [(*rows[k][:2], int(s), int(e) + window) for k, s, e in zip(of[new], first[new], first[last])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, out = [], 0, []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "content", "s", "e"])
        for b in batches:
            for row in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("key", "content", "n", "words"))):
                if rows and row[:2] == rows[-1][:2]:
                    continue
                if rows and row[0] != rows[-1][0] and size > shard_words:
                    out += shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[3].count(b" ") + 1
            if len(out) > 10_000:
                yield pack()
                out = []
        if rows:
            out += shard(rows)
        if out:
            yield pack()

    return each


TAKEN = "key long, content long, n long, words binary, way int, s long, e long"


def _take(window: int, shard_words: int):
    """Wanted contents of texts: those alone under their key as what the index of their own shard finds of them, the others as words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [x.split()[0] for x in TAKEN.split(", ")], []

        def give() -> Iterator[pa.RecordBatch]:
            for m in _search(window, shard_words)(iter(held)):
                n = m.num_rows
                yield pa.RecordBatch.from_arrays([m["key"], m["content"], pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([ALONE] * n, pa.int32()), m["s"], m["e"]], names=names)
            held.clear()

        for b in _contents(batches):
            alone = pc.equal(b["way"], ALONE)
            own = b.filter(alone)
            if own.num_rows:
                held.append(own)
            if sum(x["words"].nbytes for x in held) > SLICE_BYTES:
                yield from give()
            rest = b.filter(pc.invert(alone))
            if rest.num_rows:
                none = pa.nulls(rest.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*rest.columns, none, none], names=names)
        yield from give()

    return each


def _merged(intervals: DataFrame) -> DataFrame:
    """Intervals (a, b, s, e) of each text, those that overlap or touch as one."""
    by = W.partitionBy("a", "b").orderBy("s")
    reach = F.max("e").over(by.rowsBetween(W.unboundedPreceding, -1))
    runs = intervals.withColumn("new", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("a", "b", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("a", "b", "s", "e")


def _matches(base: DataFrame, texts: DataFrame, window: int, anchors: tuple[int, ...], shard_words: int, key_words: int) -> DataFrame:
    """(a, b, s, e): intervals of words of each text (a, b, n, text; n: how many texts it stands for) that lie in windows with another place. texts: a, b, text, partitioned by a and b."""
    spark = base.sparkSession
    every = spill_table(spark, base.mapInArrow(tidy(_segments(window, anchors[0])), SEGMENTS), "segments")
    twice = every.groupBy("key").agg(F.sum("n").alias("n"), F.max("inner").alias("inner")).where("n > 1 or inner").select("key")
    segments = spill_table(spark, every.join(twice, "key", "left_semi"), "repeated-segments")
    discard(every)
    kinds = segments.groupBy("key", "content").agg(F.sum("n").alias("n"), F.min(F.struct("a", "b", "place")).alias("row")).select("key", "content", "n", "row.*")
    key = W.partitionBy("key")
    words = F.sum(F.col("place").bitwiseAND(_LENGTH)).over(key)
    way = F.when(words > key_words, LARGE).when(F.count(F.lit(1)).over(key) == 1, ALONE) if len(anchors) > 1 else F.when(F.count(F.lit(1)).over(key) == 1, ALONE)
    kinds = spill_table(spark, kinds.withColumn("way", way.otherwise(MANY)), "contents")
    split = len(anchors) > 1 and kinds.where(F.col("way") == LARGE).limit(1).count() > 0
    asked = kinds.groupBy("a", "b").agg(F.collect_list(F.struct("key", "content", "n", "place", "way")).alias("wanted"))
    # One pass over the texts: contents that are alone under their key are searched where they stand, the others' words are written out.
    found = spill_table(spark, texts.join(asked, ["a", "b"]).select("a", "b", "text", "wanted").mapInArrow(tidy(_take(window, shard_words)), TAKEN), "taken")
    contents = lambda way: found.where(F.col("way") == way).select("key", "content", "n", "words")
    together = contents(MANY).repartition("key").sortWithinPartitions("key", "content")
    out = found.where(F.col("way") == ALONE).select("key", "content", "s", "e").unionByName(together.mapInArrow(tidy(_search(window, shard_words)), MATCHES))
    if split:
        deeper = contents(LARGE).dropDuplicates(["key", "content"])
        deeper = spill_table(spark, deeper.select(F.col("key").alias("a"), F.col("content").alias("b"), "n", F.col("words").alias("text")), "split")
        # A long text that repeats itself has an interval for each of its windows there; as one they never fill a row of the texts' intervals.
        again = _merged(_matches(deeper, deeper.select("a", "b", "text").repartition("a", "b"), window, anchors[1:], shard_words, key_words))
        out = out.unionByName(again.select(F.col("a").alias("key"), F.col("b").alias("content"), "s", "e"))
    start = F.shiftright("place", _START_BITS)
    return segments.join(out, ["key", "content"]).select("a", "b", (start + F.col("s")).alias("s"), (start + F.col("e")).alias("e"))


def repeated_intervals(docs: DataFrame, *, window: int = WINDOW, anchors: tuple[int, ...] = ANCHORS, shard_words: int = SHARD_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """did, th, spans (array of word intervals): the words of each document that lie in a window which also starts elsewhere.

    Every window has a key, the smallest hash among its n-grams of a few words, and runs of windows with one key are segments: all places of a window are in
    segments of one key, so keys are shards that need no other. Segments whose key is at one place only are let go. The rest's distinct contents, with the number of
    their places, are brought to their shards, indexed there and streamed through the index; what matches over a window at two places or more is reported for every place.

    A key with more than key_words distinct words (a short line in very many contexts, a text that repeats itself) is split: its contents are cut again by keys
    from longer n-grams, in the end by whole windows, each a key of its own, whose places are counted before their words are touched. So an index is bounded, and no window is given up.
    """
    spark = docs.sparkSession
    ship_code(spark)
    base = spread(keyed(docs)).select(F.col("did").alias("a"), F.col("th").alias("b"), F.lit(1).cast("long").alias("n"), "text")
    steps = (*[a for a in anchors if a < window], window)
    texts = keyed(docs).repartition("did", "th").select(F.col("did").alias("a"), F.col("th").alias("b"), "text")
    every = _matches(base, texts, window, steps, shard_words, key_words).distinct()
    return every.groupBy(F.col("a").alias("did"), F.col("b").alias("th")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))


CUT = "doc_id long, did long, th long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(digest_only: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            for part in slices(b):
                data, at = raw(part.column(names.index("text")))
                w = Words(data, at)
                spans = part.column(names.index("spans"))
                cover = np.zeros(len(w) + 1, np.int64)
                if spans.null_count < len(spans):
                    flat = spans.flatten()
                    row = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
                    np.add.at(cover, w.first[row] + flat.field("s").to_numpy(), 1)
                    np.add.at(cover, w.first[row] + flat.field("e").to_numpy(), -1)
                keep = np.cumsum(cover[:-1]) == 0
                starts, ends = w.starts[keep], w.ends[keep]
                docs = part.num_rows
                counts = np.bincount(w.doc[keep], minlength=docs)
                sizes = ends - starts + 1
                to = np.append(0, np.cumsum(sizes))
                index = np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])
                text = np.append(data, np.uint8(32))[index]
                text[to[1:] - 1] = 32
                text = text.tobytes()
                bounds = to[np.append(0, np.cumsum(counts))]
                kept = [text[bounds[i] : max(bounds[i], bounds[i + 1] - 1)] for i in range(docs)]
                n = np.diff(w.first)
                did = part.column(names.index("did"))
                null = did.to_numpy() == _NULL
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did.to_numpy(), mask=null), did, part.column(names.index("th")), pa.array(n), pa.array(n - counts), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.nulls(docs, pa.string()) if digest_only else pa.array([k.decode() for k in kept], pa.string())],
                    names=[x.split()[0] for x in CUT.split(", ")],
                )

    return each


def remove_repeats(docs: DataFrame, *, digest_only: bool = False, **options) -> DataFrame:
    """doc_id, did, th, n_words, n_removed, kept_sha256, kept: every document without the words of windows that also start elsewhere.

    A window is `window` consecutive words of one document; elsewhere means any other start, in the same document or not; windows are judged on the input. kept is
    the rest, joined by one space. Null and empty texts have no words and lose none; equal texts of at least a window lose all;
    repeated rows count as copies of each other; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
    """
    spans = repeated_intervals(docs, **options)
    return keyed(docs).repartition("did", "th").join(spans, ["did", "th"], "left").select("did", "th", "text", "spans").mapInArrow(tidy(_cut(digest_only)), CUT)


def cut_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated words cut from their texts. Untouched documents keep their text to the byte; those of which nothing is left go.

    Columns stay as they are, but n_chars, if there, becomes the length of the new text. See remove_repeats() for nulls, empty texts and repeats.
    """
    spans = repeated_intervals(docs, **options)
    did, th, found = fresh_names(docs, "__did", "__th", "__spans")
    own = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    columns, schema = docs.columns, docs.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cut(False)
        for b in batches:
            at = {c: i for i, c in enumerate(b.schema.names)}
            for part in slices(b, "text"):
                arrays = [part.column(at[c]) for c in columns]
                asked = pa.RecordBatch.from_arrays([part.column(at[c]) for c in (did, th, "text", found)], names=["did", "th", "text", "spans"])
                result = pa.Table.from_batches(list(cut(iter([asked])))).combine_chunks()
                removed, words = result["n_removed"].to_numpy(), result["n_words"].to_numpy()
                changed = removed > 0
                place = columns.index("text")
                texts = [k if c else t for t, k, c in zip(arrays[place].to_pylist(), result["kept"].to_pylist(), changed)]
                arrays[place] = pa.array(texts, arrays[place].type)
                if "n_chars" in columns:
                    place = columns.index("n_chars")
                    arrays[place] = pa.array([len(t) if c else old for t, c, old in zip(texts, changed, arrays[place].to_pylist())], arrays[place].type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(~changed | (removed < words)))

    joined = own.join(spans.select(F.col("did").alias(did), F.col("th").alias(th), F.col("spans").alias(found)), [did, th], "left")
    return joined.select(*[f"`{c}`" for c in columns], did, th, found).mapInArrow(tidy(each), schema)
