"""Vectorised text kernels over Arrow string buffers.

All kernels work on raw UTF-8 bytes.  Separators are single ASCII bytes, which
never occur inside a multi-byte UTF-8 character, so byte level splitting is the
same as splitting the decoded text.  A batch is cut into runs of documents of
about ``CHUNK_BYTES``; only a single longer document makes a larger run, so the
memory of a task follows its longest document and not its partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: white space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
#: byte table that lower-cases A-Z and leaves everything else
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), elementwise with wrap-around."""
    x = x ^ (x >> U64(30))
    x = x * _K2
    x ^= x >> U64(27)
    x *= _K3
    x ^= x >> U64(31)
    return x


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    elif pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        col, kind = col.cast(pa.large_string()), np.int64
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=kind, count=n + 1 + col.offset)[col.offset:].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count:  # a null's slot may keep bytes: compact them away
        keep = np.asarray(col.is_valid())
        lens = np.where(keep, np.diff(offs), 0)
        if (np.diff(offs)[~keep] > 0).any():
            buf = np.concatenate([buf[a:b] for a, b, k in zip(offs[:-1], offs[1:], keep) if k] or [buf[:0]])
            offs = np.concatenate([[0], np.cumsum(lens)])
    return buf, offs


def chunks(buf: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents (first, last, bytes, offsets from 0) of about ``limit`` bytes."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, buf[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``table`` bytes in each document, and for
    each document the index of its first run (length n + 1)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[1:-1]
    cut = cut[cut < n]
    first[cut] = inside[cut]  # a word never crosses documents
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offs[1:-1] - 1
    cut = cut[cut >= 0]
    last[cut] = inside[cut]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)
LONG_PIECE = 512


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of every byte range, eight bytes a step; ranges over ``LONG_PIECE`` bytes by blake2b."""
    size = ends - starts
    h = size.astype(U64) * _K1 + U64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    if not len(starts):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    rows, at = None, 0
    long = np.flatnonzero(size > LONG_PIECE)
    todo = np.where(size > LONG_PIECE, 0, size)
    most = int(todo.max()) if len(todo) else 0
    while at < most or at == 0:
        if rows is None:
            h = mix(h ^ (eight[starts] & _MASKS[np.clip(todo, 0, 8)]))
            rows = np.flatnonzero(todo > 8)
        else:
            left = todo[rows] - at
            h[rows] = mix(h[rows] * _K1 ^ (eight[starts[rows] + at] & _MASKS[np.minimum(left, 8)]))
            rows = rows[left > 8]
        at += 8
        if not len(rows):
            break
    for k in long:
        d = hashlib.blake2b(buf[starts[k]:ends[k]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        h[k] = int.from_bytes(d, "little")
    return h


def combine(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the concatenation of two hashed pieces."""
    x = a * U64((0x9E3779B97F4A7C15 + 2 * salt * 0x2545F4914F6CDD1D) & (1 << 64) - 1 | 1)
    x ^= x >> U64(29)
    x += b
    x *= _K3
    x ^= x >> U64(32)
    return x


def window_hash(words: np.ndarray, size: int, salt: int = 1) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes, by doubling: log2(size) vector steps."""
    n = len(words)
    if n < size:
        return np.zeros(0, U64)
    done, out, power, have = 0, None, words, 1
    left = size
    while left:
        if left & 1:
            part = power[done:]
            out = part if out is None else combine(out[:len(part)], part, salt + have)
            done += have
        left >>= 1
        if left:
            power = combine(power[:-have], power[have:], salt)
            have *= 2
    return out[:n - size + 1]


def window_docs(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of ``window_hash`` over concatenated documents: the indexes of the
    windows inside one document, and that document's number.  ``first`` as from ``spans``."""
    counts = np.diff(first)
    per = np.maximum(counts - size + 1, 0)
    doc = np.repeat(np.arange(len(per)), per)
    start = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    return np.arange(int(per.sum())) + start, doc


class HashPool:
    """Open-addressing table from 64-bit hashes to row numbers, in numpy arrays."""

    def __init__(self, slots: int = 1 << 17):
        self.keys = np.zeros(slots, U64)
        self.rows = np.full(slots, -1, np.int32)
        self.size = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row number of each hash, -1 where absent."""
        mask = U64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        out = self.rows[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(todo):
            slot = (slot[todo] + 1) & int(mask) if len(slot) != len(todo) else (slot + 1) & int(mask)
            got = self.rows[slot]
            out[todo] = got
            more = (got >= 0) & (self.keys[slot] != h[todo])
            todo, slot = todo[more], slot[more]
        return out

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        """Enter distinct hashes that are not in the table."""
        while (self.size + len(h)) * 2 > len(self.keys):
            self._grow()
        self._put(h, rows)

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (h & U64(mask)).astype(np.int64)
        self.size += len(h)
        while len(h):
            free = self.rows[slot] < 0
            pick = np.zeros(len(h), bool)
            at = np.flatnonzero(free)
            if len(at):
                _, one = np.unique(slot[at], return_index=True)
                pick[at[one]] = True
                self.keys[slot[pick]] = h[pick]
                self.rows[slot[pick]] = rows[pick]
            h, rows, slot = h[~pick], rows[~pick], slot[~pick]
            taken = self.rows[slot] >= 0
            slot = np.where(taken, (slot + 1) & mask, slot)

    def _grow(self) -> None:
        used = self.rows >= 0
        h, rows = self.keys[used], self.rows[used]
        self.keys = np.zeros(len(self.keys) * 2, U64)
        self.rows = np.full(len(self.keys), -1, np.int32)
        self.size = 0
        self._put(h, rows)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every (start, length), concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[at[0]] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    del ends
    return np.cumsum(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
