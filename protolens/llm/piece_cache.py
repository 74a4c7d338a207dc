"""Worker cache from text pieces to tokenizer output, shared by token counting and packing.

A piece is a byte range of the batch buffer.  Known pieces resolve with one
vectorised hash probe; the distinct unknown ones go to the tokenizer once and
stay for the life of the Python worker.  The cache is emptied when it passes
its bounds, so a worker's memory is fixed.  Only speed depends on the cache.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from protolens.llm import kernel as K


class PieceCache:
    def __init__(self, encode: Callable[[list[bytes]], list], keep_ids: bool, max_pieces: int = 1 << 20, max_ids: int = 1 << 23):
        self.encode, self.keep_ids, self.max_pieces, self.max_ids = encode, keep_ids, max_pieces, max_ids
        self.clear()

    def clear(self) -> None:
        self.pool = K.HashPool()
        self.length = np.zeros(1 << 14, np.int32)
        self.offset = np.zeros(1 << 14, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.n, self.n_ids = 0, 0

    def rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cache row of every byte range; unknown ranges are tokenized first."""
        if self.n > self.max_pieces or self.n_ids > self.max_ids:
            self.clear()
        h = K.hash_spans(buf, starts, ends, seed=7)
        row = self.pool.find(h)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            which = miss[at]
            raw = buf.tobytes()
            got = self.encode([raw[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist())])
            row[miss] = self._enter(new, got)[back]
        return row

    def _enter(self, h: np.ndarray, got: list) -> np.ndarray:
        k = len(h)
        if self.keep_ids:
            size = np.fromiter(map(len, got), np.int32, count=k)
        else:
            size = np.asarray(got, np.int32)
        while self.n + k > len(self.length):
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
        rows = np.arange(self.n, self.n + k, dtype=np.int32)
        self.length[self.n:self.n + k] = size
        if self.keep_ids:
            total = int(size.sum())
            while self.n_ids + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.offset[self.n:self.n + k] = self.n_ids + np.concatenate([[0], np.cumsum(size)[:-1]])
            self.ids[self.n_ids:self.n_ids + total] = np.fromiter((x for g in got for x in g), np.uint32, count=total)
            self.n_ids += total
        self.pool.add(h, rows)
        self.n += k
        return rows
