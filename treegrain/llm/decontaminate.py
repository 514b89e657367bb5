"""Benchmark decontamination: test items in a BM25 inverted index with block maxima; every training passage is a query, retrieved items are verified by overlap."""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from treegrain.llm.textblock import Words, raw, slices, span_hashes, tidy
from treegrain.session import fresh_names, ship_code, spill_table, spread

K1, B = 1.2, 0.75
#: An item is retrieved if a passage has this share of the BM25 score that the item's own text would have.
RETRIEVE = 0.6
#: Shares of the question's and the answer's word n-grams that the passage must hold.
QUESTION, ANSWER, NGRAM = 0.7, 0.5, 3
#: Items of fewer words are found only as a whole, word for word.
WHOLE = 5
#: Items whose lengths differ by no more than this factor share an index, and with it the length of passages; those of up to SHORTEST words share the first.
SPREAD, SHORTEST = 4, 32
#: Postings of a block of an inverted list, which share an upper bound.
POSTINGS = 8
#: Lists of at most this many items are accumulated for all passages at once; longer ones are only bounded there.
SHORT = 4
#: Bytes of items that one index, and so one broadcast, holds at most; more items are indexed in parts.
INDEX_BYTES = 32 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(pc.utf8_lower(pa.scalar(text or "")).as_py())


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of words as textblock gives them."""
    data, at = raw(pa.array(words, pa.large_string()))
    return span_hashes(data, at[:-1], at[1:])


@dataclass
class Statistics:
    """Of the whole benchmark: number of items, mean length, items that hold each term."""

    items: int
    mean: float
    frequency: dict[str, int]


class BlockMaxIndex:
    """Inverted lists (item, impact) in order of items; impacts are shares of the item's own score, so scores lie between 0 and 1."""

    def __init__(self, items: list[list[str]], stats: Statistics):
        self.items = items
        weights, lists = [], {}
        for d, words in enumerate(items):
            counts = Counter(words)
            w = {}
            for t, tf in counts.items():
                df = stats.frequency.get(t, 1)
                idf = math.log(1 + (stats.items - df + 0.5) / (df + 0.5))
                w[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / max(stats.mean, 1e-9)))
            total = sum(w.values()) or 1.0
            weights.append({t: x / total for t, x in w.items()})
            for t, x in weights[-1].items():
                lists.setdefault(t, []).append((d, x))
        self.lists = {}
        for t, postings in lists.items():
            ids, impacts = [d for d, _ in postings], [x for _, x in postings]
            blocks = [(ids[min(k + POSTINGS, len(ids)) - 1], max(impacts[k : k + POSTINGS])) for k in range(0, len(ids), POSTINGS)]
            self.lists[t] = (ids, impacts, max(impacts), [b[0] for b in blocks], [b[1] for b in blocks])
        # Parts for the bound of all passages at once: short lists as flat arrays, and what long lists can add to each item.
        vocabulary = sorted(self.lists)
        hashes = word_hash(vocabulary) if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        short = [self.lists[vocabulary[k]][:2] if len(self.lists[vocabulary[k]][0]) <= SHORT else ([], []) for k in order]
        self.first = np.cumsum([0, *(len(ids) for ids, _ in short)])
        self.flat_items = np.array([d for ids, _ in short for d in ids], np.int64)
        self.flat_impacts = np.array([x for _, xs in short for x in xs], np.float64)
        self.rest = np.array([sum(x for t, x in w.items() if len(self.lists[t][0]) > SHORT) for w in weights])
        self.longest = max((len(w) for w in items), default=0)

    def search(self, terms: set[str], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that score at least the threshold for these terms, by block-max WAND."""
        cursors = [[self.lists[t], 0] for t in terms if t in self.lists]
        out, least = [], threshold - 1e-9
        at = lambda c: c[0][0][c[1]]
        while cursors:
            cursors.sort(key=at)
            bound, p = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[0][2]
                if bound >= least:
                    p = k
                    break
            if p < 0:
                break
            pivot = at(cursors[p])
            while p + 1 < len(cursors) and at(cursors[p + 1]) == pivot:
                p += 1
            tight, edge = 0.0, None
            for c in cursors[: p + 1]:
                k = bisect_left(c[0][3], pivot)
                if k < len(c[0][3]):
                    tight += c[0][4][k]
                    edge = c[0][3][k] if edge is None else min(edge, c[0][3][k])
            if tight >= least:
                if at(cursors[0]) == pivot:
                    score = sum(c[0][1][c[1]] for c in cursors[: p + 1])
                    if score >= least:
                        out.append((pivot, score))
                    target = pivot + 1
                else:
                    target = pivot
            else:
                # No item up to the nearest block end, or before the next list's item, can reach the threshold.
                target = edge + 1 if edge is not None else pivot + 1
                if p + 1 < len(cursors):
                    target = min(target, at(cursors[p + 1]))
                target = max(target, pivot + 1)
            for c in cursors[: p + 1]:
                if at(c) < target:
                    c[1] = bisect_left(c[0][0], target, c[1])
            cursors = [c for c in cursors if c[1] < len(c[0][0])]
        return out

    def promising(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: float) -> np.ndarray:
        """Passages (spans of words) in which some item's bound reaches the threshold: its short lists' impacts, each once, plus all its long lists' impacts.

        It is the first pivot test of every query at once; passages left out would end their search there.
        """
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = (self.hashes[place] == hashes) & (np.diff(self.first)[place] > 0)
        where = np.flatnonzero(known)
        term = place[where]
        # Passages overlap: a word belongs to those that begin at or before it and end after it.
        lo, hi = np.searchsorted(ends, where, "right"), np.searchsorted(starts, where, "right")
        n = hi - lo
        passage = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        pair = np.unique(passage * len(self.hashes) + np.repeat(term, n))
        passage, term = pair // len(self.hashes), pair % len(self.hashes)
        n = self.first[term + 1] - self.first[term]
        flat = np.repeat(self.first[term] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        key, inverse = np.unique(np.repeat(passage, n) * len(self.items) + self.flat_items[flat], return_inverse=True)
        score = np.bincount(inverse, self.flat_impacts[flat], len(key)) + self.rest[key % len(self.items)]
        found = np.unique(key[score >= threshold - 1e-9] // len(self.items))
        lone = np.flatnonzero(self.rest >= threshold - 1e-9)
        return np.arange(len(starts)) if len(lone) else found


def split_item(text: str | None, answer: str | None = None) -> tuple[list[str], list[str], int]:
    """Question and answer of an item, and the length of the n-grams to compare; without an answer of its own, the last third of its words.

    An item of fewer than WHOLE words has no parts to speak of: all its words in order are one n-gram.
    """
    words = tokens(text)
    if answer is not None and tokens(answer):
        return words, tokens(answer), NGRAM
    if len(words) < WHOLE:
        return words, [], WHOLE
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:], NGRAM


def overlap(part: list[str], grams: set[tuple], n: int = NGRAM) -> float:
    """Share of part's word n-grams (of all its words, if they are fewer) that are among grams; 1 for an empty part."""
    if not part:
        return 1.0
    k = min(n, len(part))
    own = [tuple(part[i : i + k]) for i in range(len(part) - k + 1)]
    return sum(g in grams for g in own) / len(own)


def _grams(words: list[str]) -> set[tuple]:
    return {tuple(words[i : i + k]) for k in range(1, WHOLE) for i in range(len(words) - k + 1)}


FOUND = "doc_id long, th long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, passages long"


def length_class(words: int) -> int:
    k = 0
    while words > SHORTEST * SPREAD**k:
        k += 1
    return k


def _match(shared, retrieve: float, question: float, answer: float):
    """Every passage asks the index; one index for each class of items' lengths, with passages of its own."""

    def passages(w: Words, counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.where(counts > 0, np.maximum(1, -(-(counts - step) // step)), 0)
        doc = np.repeat(np.arange(len(counts)), n)
        k = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
        starts = w.first[doc] + k * step
        return doc, starts, np.minimum(starts + 2 * step, w.first[doc + 1])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            for part in slices(b):
                text = pc.utf8_lower(part.column(names.index("text")).fill_null(""))
                w = Words(*raw(text))
                if not len(w):
                    continue
                counts, hashes, data = np.diff(w.first), w.hashes(), w.data.tobytes()
                hits: dict[tuple[int, int, int], list] = {}
                for kind, (index, _, parts) in enumerate(shared.value):
                    doc, starts, ends = passages(w, counts, max(SHORTEST, index.longest))
                    for p in index.promising(hashes, starts, ends, retrieve):
                        words = [data[w.starts[i] : w.ends[i]].decode() for i in range(starts[p], ends[p])]
                        found = index.search(set(words), retrieve)
                        if not found:
                            continue
                        grams = _grams(words)
                        for item, score in found:
                            *sides, n = parts[item]
                            q, a = (overlap(x, grams, n) for x in sides)
                            if q >= question and a >= answer:
                                d = int(doc[p])
                                h = hits.setdefault((d, kind, item), [0.0, 0.0, 0.0, int(starts[p] - w.first[d]), 0])
                                h[:3] = max(h[0], score), max(h[1], q), max(h[2], a)
                                h[4] += 1
                if hits:
                    did, th = part.column(names.index("doc_id")).to_pylist(), part.column(names.index("th")).to_pylist()
                    rows = [(did[d], th[d], shared.value[kind][1][item], *h) for (d, kind, item), h in hits.items()]
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    return each


def contaminated(docs: DataFrame, benchmark: DataFrame, *, retrieve: float = RETRIEVE, question: float = QUESTION, answer: float = ANSWER, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document and test item that it holds: doc_id, th (hash of the text), item_id, best score and overlaps, place of the first passage, number of passages.

    Documents are cut into passages of twice the words of the longest item (of those of like length), each overlapping the next by half, so any item that
    occurs in a document lies whole in some passage. All passages are queries. An item (item_id, text, optionally answer) is retrieved if the
    passage reaches the share `retrieve` of the item's own BM25 score, and reported if enough word n-grams of its question and of its
    answer (without one: the last third) are in the passage. Items of any length count; one of fewer than WHOLE words must occur word for word. Case and white space do not matter.

    Null and empty texts hold no item; null and empty items are in no document; equal rows of items count once; repeated
    documents are reported each; a null doc_id stays null; empty tables give no rows; other columns are ignored. Indexes are
    broadcast, at most `index_bytes` of item text at a time: a larger benchmark is matched in parts, with statistics of the whole, and
    what a part found is written out before the next part's indexes take its place.
    """
    spark = docs.sparkSession
    ship_code(spark)

    def split(s):
        import pandas as pd

        return pd.Series([tokens(t) for t in s])

    own = ["item_id", "text"] + (["answer"] if "answer" in benchmark.columns else [])
    items = benchmark.select(*own).where("text is not null").distinct()
    items = items.withColumn("__words", F.pandas_udf(split, "array<string>")("text")).where(F.size("__words") > 0)
    total = items.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("__words")).alias("mean"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, math.ceil((total["bytes"] or 0) / index_bytes))
    frequency = items.select(F.explode(F.array_distinct("__words")).alias("term")).groupBy("term").count()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    out = None
    for k in range(parts):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else items
        terms = frequency if parts == 1 else frequency.join(mine.select(F.explode("__words").alias("term")).distinct(), "term", "left_semi")
        chosen = sorted((tuple(r) for r in mine.select(*own).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        stats = Statistics(total["n"], float(total["mean"] or 0), {r["term"]: r["count"] for r in terms.collect()})
        classes: dict[int, list] = {}
        for r in chosen:
            classes.setdefault(length_class(len(tokens(r[1]))), []).append(r)
        shared = spark.sparkContext.broadcast([(BlockMaxIndex([tokens(r[1]) for r in rs], stats), [r[0] for r in rs], [split_item(*r[1:]) for r in rs]) for _, rs in sorted(classes.items())])
        found = spread(rows).mapInArrow(tidy(_match(shared, retrieve, question, answer)), FOUND)
        if parts > 1:
            found = spill_table(spark, found, "contaminated")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a test item; all columns are kept, every other row stays. See contaminated()."""
    did, th = fresh_names(docs, "__did", "__th")
    hits = contaminated(docs, benchmark, **options).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(did), F.col("th").alias(th)).distinct()
    own = docs.withColumns({did: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), th: F.xxhash64(F.coalesce("text", F.lit("")))})
    return own.join(hits, [did, th], "left_anti").select(*[f"`{c}`" for c in docs.columns])
