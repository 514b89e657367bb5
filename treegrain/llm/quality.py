"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output, stochastic gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from treegrain.llm.textblock import Words, mix, raw, slices, tidy
from treegrain.session import ship_code, spread

BUCKETS = 1 << 16
DIM = 8
CHAR_NGRAMS = (3, 4)
#: Labelled documents that training reads at most: those with the smallest hashes of their doc_id. It bounds the driver's memory and time.
TRAIN_DOCS = 4000
EPOCHS = 5
RATE = 0.5
BATCH = 16
THRESHOLD = 0.7
_ODD = np.uint32(0x9E3779B1)
_FAMILIES = 2 + len(CHAR_NGRAMS)
_CLASS = np.full(256, 5, np.uint64)
_CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]], _CLASS[[33, 44, 46, 58, 59, 63]], _CLASS[[*range(128, 256)]] = 0, 1, 2, 3, 4


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every word, word shape and character n-gram, one family after another; each family has its own range of buckets."""
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    words = Words(data, offsets)
    own = words.hashes()
    yield words.doc, (own >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)
    yield words.doc, _shapes(words, own) + (_FAMILIES - 1) * BUCKETS
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    wide = data.astype(np.uint32)
    for k, n in enumerate(CHAR_NGRAMS, 1):
        m = len(data) - n + 1
        if m <= 0:
            yield doc[:0], np.zeros(0, np.int32)
            continue
        h = wide[:m].copy()
        for j in range(1, n):
            h |= wide[j : j + m] << np.uint32(8 * j)
        h *= _ODD
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        b = (h >> shift).astype(np.int32) + k * BUCKETS
        same = doc[:m] == doc[n - 1 :]
        yield doc[:m][same], b[same]


def _shapes(words: Words, own: np.ndarray) -> np.ndarray:
    """Buckets of word trigrams without their letters: whether the word repeats the one or two before it, its ends' classes, its length."""
    if len(words) == 0:
        return np.zeros(0, np.int32)
    x = np.minimum(words.ends - words.starts, 31).astype(np.uint64) * np.uint64(64)
    x += _CLASS[words.data[words.starts]] * np.uint64(8) + _CLASS[words.data[words.ends - 1]]
    for back in (1, 2):
        same = np.zeros(len(words), bool)
        same[back:] = (own[back:] == own[:-back]) & (words.doc[back:] == words.doc[:-back])
        x += same.astype(np.uint64) << np.uint64(12 + back)
    return (mix(x) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)


@dataclass
class Model:
    """scalars: what each bucket adds to the log odds of label 1 once its vector has met the output layer; bias: the rest."""

    scalars: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each document; a text without features gets the bias alone."""
        n = len(offsets) - 1
        total, count = np.zeros(n), np.zeros(n)
        for doc, bucket in features(data, offsets):
            total += np.bincount(doc, self.scalars[bucket], n)
            count += np.bincount(doc, minlength=n)
        z = total / np.maximum(count, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], labels: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Fit vectors and output layer by minibatch gradient descent on the softmax loss, with a step that falls linearly to 0.

    No texts: every score is 0.5. One label only: the model tends to that label.
    """
    if not texts:
        return Model(np.zeros(_FAMILIES * BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (_FAMILIES * BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    docs = []
    for t in texts:
        data, at = raw(pa.array([t]))
        ids = np.concatenate([b for _, b in features(data, at)])
        u, c = np.unique(ids, return_counts=True)
        docs.append((u, (c / max(1, len(ids))).astype(np.float32)))
    target = np.eye(2, dtype=np.float32)[labels]
    steps, done = epochs * -(-len(docs) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            lr = rate * (1 - done / steps)
            done += 1
            ids = np.concatenate([docs[i][0] for i in part])
            w = np.concatenate([docs[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
            mean = np.stack([np.bincount(row, vectors[ids, d] * w, len(part)) for d in range(DIM)], 1).astype(np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = target[part] - p
            gm = g @ out.T
            out += lr * (mean.T @ g)
            bias += lr * g.mean(0)
            u, inverse = np.unique(ids, return_inverse=True)
            # The step of a vector follows how often its bucket occurs in a text, times a constant that makes up for the averaging.
            scale = w * np.float32(lr * 40)
            for d in range(DIM):
                vectors[u, d] += np.bincount(inverse, gm[row, d] * scale, len(u)).astype(np.float32)
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def is_held_out(doc_id):
    """Rows that training never sees: crc32 of doc_id as text leaves 2 modulo 4. A null doc_id is held out: it can't be told apart."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_DOCS) -> Model:
    """Train on at most `limit` labelled rows outside the held-out fold, those with the smallest hash of doc_id, with their whole texts.

    Labels other than 0 and 1 and null labels are left out; a doc_id with several labels counts with the smallest.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * limit).collect()
    return train([r["text"] for r in rows], np.array([r["__label"] for r in rows], int))


def score_column(docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """docs with the score of each text (null: empty) added; every column is kept, one of that name is replaced. No shuffle."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)
    plain = docs.drop(score_col)
    fields = plain.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                scores = shared.value.score(*raw(part.column(fields.index("text"))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*fields, score_col])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return plain.mapInArrow(tidy(each), StructType([*plain.schema.fields, StructField(score_col, DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold) of every document.

    Only the text is an input of the score. Null and empty texts are scored by the model's bias; equal texts have equal scores; repeated rows stay apart;
    without labels every score is 0.5; an empty table gives no rows; other columns are ignored.
    """
    scored = score_column(spread(docs.select("doc_id", "text")), fit(docs, labels, limit=limit))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
