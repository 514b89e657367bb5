"""The best rows of each query, kept while a task streams through its part of the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

FOUND = "query_id long, id long, pos long, score double"


def choose(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of non-negative or negative integer scores (millionths), the columns of the k largest, of equal ones the first; and their scores. Nothing is sorted."""
    m = scores.shape[1]
    n = min(k, m)
    order = scores * m - np.arange(m)
    top = np.argpartition(order, m - n, axis=1)[:, m - n :] if n < m else np.tile(np.arange(m), (len(scores), 1))
    return top, np.take_along_axis(scores, top, 1)


class TopK:
    """At most k rows for each query, the largest scores, of equal ones the smallest position, then id. It holds a few times queries * k rows, however many are added."""

    def __init__(self, k: int, queries: int):
        self.k, self.limit = k, 4 * k * max(1, queries) + 100_000
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, query: np.ndarray, ids: np.ndarray, pos: np.ndarray, score: np.ndarray) -> bool:
        """Whether rows were let go, so that least() has changed."""
        self.parts.append((query, ids, pos, score))
        self.size += len(query)
        if self.size <= self.limit:
            return False
        self._prune()
        return True

    def least(self, queries: np.ndarray) -> np.ndarray:
        """The k-th best score of each query as rows were last let go; -inf where there were fewer than k."""
        query, score = self.parts[0][0], self.parts[0][3]
        first = np.searchsorted(query, queries)
        full = np.searchsorted(query, queries, "right") - first >= self.k
        out = np.full(len(queries), -np.inf)
        out[full] = score[first[full] + self.k - 1]
        return out

    def _prune(self) -> None:
        query, ids, pos, score = (np.concatenate(c) for c in zip(*self.parts))
        by = np.lexsort((ids, pos, -score, query))
        query = query[by]
        first = np.searchsorted(query, query)
        by = by[np.arange(len(by)) - first < self.k]
        self.parts = [(np.concatenate([p[0] for p in self.parts])[by], ids[by], pos[by], score[by])]
        self.size = len(by)

    def rows(self) -> pa.RecordBatch:
        if self.parts:
            self._prune()
        columns = self.parts[0] if self.parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "pos", "score"])
