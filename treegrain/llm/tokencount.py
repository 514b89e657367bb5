"""Exact token counts of byte-level BPE: a heap of ranked pairs over a linked list of symbols; no identifier is ever emitted."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from treegrain.llm.textblock import tidy
from treegrain.session import ship_code, spread

#: How words are split before merging (contractions, letters, digits, other signs, white space), as byte-level tokenizers do by default.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Word counts that a worker remembers; beyond, it forgets all and starts anew, which changes no result.
REMEMBERED = 1_000_000
_BITS = 24


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class PairMerger(dict):
    """word -> number of tokens; a missing word is counted by merging. Its ranks come from a tokenizer file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        self.rank = {vocab[a] * self.width + vocab[b]: i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.merged = [vocab[a + b] for a, b in merges]
        self.unit = [vocab[c] for _, c in sorted(_byte_characters().items())]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def __missing__(self, word: str) -> int:
        n = self.count(word.encode())
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n

    def count(self, data: bytes) -> int:
        """Initial symbols (bytes) minus merges; the pair of lowest rank is merged first, the leftmost of equal ones."""
        n = len(data)
        if n < 2:
            return n
        rank, width, merged = self.rank, self.width, self.merged
        symbol = [self.unit[b] for b in data]
        get, mask = rank.get, (1 << _BITS * 2) - 1
        heap = []
        for i in range(n - 1):
            r = get(symbol[i] * width + symbol[i + 1])
            if r is not None:
                heap.append(r << _BITS * 2 | i)
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            x = heappop(heap)
            i = x & mask
            j = after[i]
            s = symbol[i]
            if j >= n or s < 0 or get(s * width + symbol[j]) != x >> _BITS * 2:
                continue
            symbol[i] = s = merged[x >> _BITS * 2]
            symbol[j] = -1
            left -= 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                r = get(s * width + symbol[j])
                if r is not None:
                    heappush(heap, r << _BITS * 2 | i)
            j = before[i]
            if j >= 0:
                r = get(symbol[j] * width + s)
                if r is not None:
                    heappush(heap, r << _BITS * 2 | j)
        return left


@functools.cache
def _merger(path: str) -> tuple:
    import regex

    merger = PairMerger(path)
    special = regex.compile("|".join(regex.escape(s) for s in sorted(merger.special, key=len, reverse=True))) if merger.special else None
    return merger, regex.compile(PATTERN).findall, special


def count_text(text: str, path: str) -> int:
    """Tokens of one text: special strings in it are one token each, all else is split into words and merged."""
    merger, split, special = _merger(path)
    if special is None or not special.search(text):
        return sum(map(merger.__getitem__, split(text)))
    return sum(sum(map(merger.__getitem__, split(part))) for part in special.split(text)) + len(special.findall(text))


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text; one narrow pass, no shuffle.

    Null text counts as empty and has 0 tokens. Repeated rows and repeated doc_ids stay apart, a null doc_id stays null, an empty
    table gives no rows, other columns are ignored. Words are counted once per worker and remembered (a bounded cache).
    """
    path = tokenizer or default_tokenizer()
    ship_code(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = [count_text(t, path) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return spread(docs.select("doc_id", "text")).mapInArrow(tidy(each), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
