"""Arrow list columns as numpy matrices, for code inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists as a double matrix, without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    lengths = np.diff(column.offsets.to_numpy()) if hasattr(column, "offsets") else None
    if lengths is not None and (lengths != lengths[0]).any():
        raise ValueError("vectors of unequal length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    if m.size == 0:
        return m
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, highest first, lowest id on ties."""
    if k < len(scores):
        # Everything at or above the k-th score stays in, so ties are decided by id.
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= kth)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


class Best:
    """The ``limits`` best rows of each of many queries, of rows that are offered in any order.

    Highest score first, lowest id on ties. ``floor`` is what a query's k-th score is at least
    and ``edge`` the id of that row once it is known; what comes after it is dropped as it comes.
    Scores are rounded to ``digits`` places if given.
    """

    #: Offered rows that are held before they are sorted.
    HELD = 1 << 20
    OPEN = np.iinfo(np.int64).max

    def __init__(self, limits: np.ndarray, digits: int | None = None):
        self.limits = np.asarray(limits, np.int64)
        self.most = max(1, int(self.limits.max(initial=1)))
        self.floor = np.where(self.limits > 0, -np.inf, np.inf)
        self.edge = np.full(len(self.limits), self.OPEN)
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.digits, self.slack = digits, 0.0 if digits is None else 2 * 10.0**-digits
        self._offered, self._held = [], 0

    def offer(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a row for each of the ``query`` numbers and a column for each id."""
        q, row = self.near(query, scores)
        self.offer_pairs(query[q], ids[row], scores[q, row])

    def near(self, query: np.ndarray, scores: np.ndarray, off: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of ``scores`` that may be among the best, if none is off by more than ``off``."""
        fresh = np.flatnonzero(np.isneginf(self.floor[query]))
        at = scores.shape[1] - self.most
        if len(fresh) and at > 0:
            self.floor[query[fresh]] = np.partition(scores[fresh], at, axis=1)[:, at] - off
        least = (self.floor[query] - self.slack - off).astype(scores.dtype)
        return np.nonzero(scores >= least[:, None])

    def offer_pairs(self, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        """A query number, an id and a score each."""
        if not len(q):
            return
        if self.digits is not None:
            s = np.round(s, self.digits) + 0.0
        floor, edge = self.floor[q], self.edge[q]
        kept = (s > floor) | ((s == floor) & (i < edge)) | (edge == self.OPEN) & (s >= floor - self.slack)
        self._offered.append((q[kept], i[kept], s[kept]))
        self._held += int(kept.sum())
        if self._held >= self.HELD:
            self.sort()

    def sort(self) -> None:
        """Keep the best of what was offered, in order of query and rank."""
        new = zip(*self._offered, strict=True) if self._offered else ((), (), ())
        q, i, s = (np.concatenate((old, *more)) for old, more in zip(
            (self.query, self.id, self.score), new, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.limits)))[q]
        last = rank == self.limits[q] - 1
        self.floor[q[last]], self.edge[q[last]] = s[last], i[last]
        kept = rank < self.limits[q]
        self.query, self.id, self.score = q[kept], i[kept], s[kept]
        self._offered, self._held = [], 0
