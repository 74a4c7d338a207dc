"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and bytes over 127, A-Z lower-cased; in scripts written without spaces
(``UNSPACED``) every character is a token, and their punctuation (``BETWEEN``) is none.  A document and a benchmark
item are a candidate pair when they share a seed of ``LEAST`` consecutive tokens, or of all tokens of an item
that has fewer; the seeds they share
bound what tiling can cover, and pairs whose bound is under the threshold go no further.  For the rest
tiling repeatedly marks the longest matches of unmarked tokens, ``LEAST`` tokens or more, until none is
left (running Karp-Rabin: hashes of many tokens find where long matches run, then of half as many, down to ``LEAST``).  Marked tokens never
match again, so passages count whatever order they come in, and once only.  An item leaks into a
document when its marked share is ``threshold`` or more.

The benchmark goes to the executors in blocks of ``BLOCK_BYTES`` of text; each block is one pass over the
documents, which are neither shuffled nor cut.  A larger benchmark means more passes, never a larger
broadcast.

Edge cases: null or empty texts and items without a token hold nothing; an item of fewer than ``LEAST`` tokens
leaks where all of it stands in a row; equal items are reported each; repeated rows are tested each; other columns
are passed over.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.llm import kernel as K
from protolens.llm.common import prepare, texts, written
from protolens.llm.toxicity import WORD

#: tokens of a seed, and of the shortest tile
LEAST = 5
#: share of an item's tokens that must be tiled
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
_BITS = 22
#: pairs of equal windows looked at in one step
_PAIRS = 1 << 20


#: code points of scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, kana, ideographs and their extensions
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
            (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
#: ideographic and full-width punctuation
BETWEEN = ((0x3000, 0x3004), (0x3008, 0x303F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
_ONE, _NONE = 1, 2
_KIND = np.zeros(0x40000, np.uint8)
for _kind, _ranges in ((_ONE, UNSPACED), (_NONE, BETWEEN)):
    for _a, _b in _ranges:
        _KIND[_a:_b + 1] = _kind


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = K.LOWER[buf]
    at = np.flatnonzero(low >= 0xE0)  # first bytes of three or four
    at = at[at + 2 + (low[at] >= 0xF0) < len(low)]
    wide = low[at] >= 0xF0
    byte = [low[np.minimum(at + k, len(low) - 1)].astype(np.int64) & 0x3F for k in range(4)]
    code = np.where(wide, (byte[0] & 7) << 18 | byte[1] << 12 | byte[2] << 6 | byte[3], (byte[0] & 15) << 12 | byte[1] << 6 | byte[2])
    kind = _KIND[np.minimum(code, len(_KIND) - 1)] * (code < len(_KIND))
    if not kind.any():
        s, e, first = K.spans(low, offs, WORD)
        return K.hash_spans(low, s, e, seed=3), first
    words, width = low.copy(), 3 + wide
    for k in range(4):
        words[at[(kind > 0) & (width > k)] + k] = 0x20
    s, e, _ = K.spans(words, offs, WORD)
    one = kind == _ONE
    s, e = np.concatenate([s, at[one]]), np.concatenate([e, at[one] + width[one]])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    return K.hash_spans(low, s, e, seed=3), np.searchsorted(s, offs)


def _matches(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(-length, start in a, start in b) of the maximal matches of ``size`` free tokens or more.

    Hashes of ``size`` tokens find the places where the two agree, ``_PAIRS`` at a time; only those where a match begins or
    ends are held, and one end follows each beginning on its diagonal."""
    if min(len(a), len(b)) < size:
        return []
    ha, hb = K.window_hash(a, size), K.window_hash(b, size)
    at_a, at_b = (np.flatnonzero(c[size:] - c[:-size] == size) for c in (np.concatenate([[0], np.cumsum(f)]) for f in (free_a, free_b)))
    if not len(at_a) or not len(at_b):
        return []
    at_a = at_a[np.argsort(ha[at_a], kind="stable")]
    key = ha[at_a]
    lo, hi = np.searchsorted(key, hb[at_b], side="left"), np.searchsorted(key, hb[at_b], side="right")
    at_b, lo, hi = (v[hi > lo] for v in (at_b, lo, hi))

    def agree(x, y):
        ok = (x >= 0) & (y >= 0) & (x < len(a)) & (y < len(b))
        ok[ok] = (a[x[ok]] == b[y[ok]]) & free_a[x[ok]] & free_b[y[ok]]
        return ok

    begins, ends = [], []
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    first = 0
    while first < len(at_b):
        last = max(first + 1, int(np.searchsorted(total, total[first] + _PAIRS, side="right")) - 1)
        many = hi[first:last] - lo[first:last]
        x, y = at_a[K.ragged(lo[first:last], many)], np.repeat(at_b[first:last], many)
        for out, step in ((begins, -1), (ends, size)):
            edge = ~agree(x + step, y + step)
            out.append(np.stack([y[edge] - x[edge], x[edge]]))
        first = last
    if not begins:
        return []
    (diagonal, x), (_, end) = (v[:, np.lexsort((v[1], v[0]))] for v in (np.concatenate(begins, 1), np.concatenate(ends, 1)))
    return list(zip((x - end - size).tolist(), x.tolist(), (x + diagonal).tolist()))


def _free_parts(free: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, length) of the runs of ``least`` or more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    return [(int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2]) if e - s >= least]


def tile(a: np.ndarray, b: np.ndarray, least: int = LEAST, enough: float = np.inf) -> list[tuple[int, int, int]]:
    """Greedy tiling of token arrays: (start in a, start in b, length), longest first, ties by place.

    Running Karp-Rabin: matches are searched by hashes of half of a, then of half that length, down to ``least`` tokens.
    At each length the longest match is marked first; one that marked tokens cut goes back with what is left of it,
    if that is long enough, or is found again at a shorter length.  Tiling stops once ``enough`` tokens are tiled."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    out: list[tuple[int, int, int]] = []
    tiled, size = 0, max(least, min(len(a), len(b)) // 2)
    while True:
        heap = _matches(a, b, free_a, free_b, size)
        heapq.heapify(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            free = free_a[i:i - n] & free_b[j:j - n]
            if free.all():
                if not np.array_equal(a[i:i - n], b[j:j - n]):  # equal hashes are only a hint
                    continue
                free_a[i:i - n] = free_b[j:j - n] = False
                out.append((i, j, -n))
                tiled -= n
                if tiled >= enough:
                    return out
            else:
                for s, left in _free_parts(free, size):
                    heapq.heappush(heap, (-left, i + s, j + s))
        if size == least:
            return out
        size = max(least, size // 2)


class Items:
    """A block of benchmark items, those of ``least`` tokens or more together, shorter ones by their length."""

    def __init__(self, ids: list, text: list[str | None], least: int):
        buf, offs = K.string_buffers(pa.array([t or "" for t in text], pa.large_string()))
        tok, first = tokens(buf, offs)
        keep = [k for k in range(len(ids)) if first[k + 1] > first[k]]
        self.ids = [ids[k] for k in keep]
        items = [tok[first[k]:first[k + 1]] for k in keep]
        size = [min(len(t), least) for t in items]
        self.seeds = [Seeds([i for i, x in enumerate(size) if x == n], items, n) for n in sorted(set(size))]

    def hits(self, tok: np.ndarray, first: np.ndarray) -> dict[int, list]:
        """(seeds, places of those that are known), by document of a run."""
        out: dict[int, list] = {}
        for seeds in self.seeds:
            for doc, places in seeds.hits(tok, first).items():
                out.setdefault(doc, []).append((seeds, places))
        return out

    def leaks(self, own: np.ndarray, begin: int, found: list, threshold: float) -> list[tuple[int, int, int, int]]:
        """(item, tiles, tiled tokens, item tokens) of the items that leak into the tokens ``own``, which start at ``begin``."""
        return [leak for seeds, places in found for leak in seeds.leaks(own, places - begin, threshold)]

    def any_leak(self, own: np.ndarray, begin: int, found: list, threshold: float) -> bool:
        """Whether an item leaks; tiling stops at the threshold, and with the first leak."""
        return any(True for seeds, places in found for _ in seeds.leaks(own, places - begin, threshold, stop=True))


class Seeds:
    """Token hashes of some items, and their sorted seeds of ``least`` tokens with their places."""

    def __init__(self, which: list[int], items: list[np.ndarray], least: int):
        self.least, self.which = least, which
        self.tokens = [items[k] for k in which]
        seeds = [K.window_hash(t, least) for t in self.tokens]
        h = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        at = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order], item[order], at[order]
        self.gate = np.zeros(1 << _BITS, bool)
        self.gate[(self.h >> K.U64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, tok: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
        """Places of known seeds, by document of a run."""
        h = K.window_hash(tok, self.least)
        at, doc = K.window_docs(first, self.least)
        maybe = np.flatnonzero(self.gate[(h[at] >> K.U64(64 - _BITS)).astype(np.int64)]) if len(at) else np.zeros(0, np.int64)
        at, doc = at[maybe], doc[maybe]
        if not len(at) or not len(self.h):
            return {}
        place = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
        real = self.h[place] == h[at]
        at, doc = at[real], doc[real]
        cut = np.flatnonzero(np.diff(doc)) + 1
        return {int(doc[g[0]]): at[g] for g in np.split(np.arange(len(doc)), cut) if len(g)}

    def leaks(self, own: np.ndarray, places: np.ndarray, threshold: float, stop: bool = False) -> Iterator[tuple[int, int, int, int]]:
        """(item, tiles, tiled tokens, item tokens) of the items that leak into the tokens ``own``; ``stop`` tiles no further than to the threshold."""
        h = K.window_hash(own, self.least)
        # only tokens inside a known seed can be tiled; runs apart from each other stay apart
        inside = np.zeros(len(own) + 1, np.int64)
        np.add.at(inside, places, 1)
        np.add.at(inside, np.minimum(places + self.least, len(own)), -1)
        part = np.cumsum(inside[:-1]) > 0
        runs = np.flatnonzero(part)
        gap = np.flatnonzero(np.diff(runs) > 1) + 1
        some = np.insert(own[runs], gap, K.U64(0))  # 0 separates: no token of an item equals it
        lo = np.searchsorted(self.h, h[places], side="left")
        hi = np.searchsorted(self.h, h[places], side="right")
        shared = np.unique(K.ragged(lo, hi - lo))
        order = shared[np.argsort(self.item[shared], kind="stable")]
        cut = np.flatnonzero(np.diff(self.item[order])) + 1
        for g in np.split(order, cut):
            item = int(self.item[g[0]])
            mine = self.tokens[item]
            cover = np.zeros(len(mine) + 1, np.int64)
            np.add.at(cover, self.at[g], 1)
            np.add.at(cover, self.at[g] + self.least, -1)
            if (np.cumsum(cover[:-1]) > 0).sum() < threshold * len(mine):
                continue
            tiles = tile(mine, some, self.least, max(1, threshold * len(mine)) if stop else np.inf)
            tiled = sum(n for *_, n in tiles)
            if tiled >= threshold * len(mine):
                yield self.which[item], len(tiles), tiled, len(mine)


def each_block(benchmark: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[Items, bool]]:
    """(block, whether it is the only one), built one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()  # about block_bytes
        yield Items(got.column("item_id").to_pylist(), got.column("text").to_pylist(), least), n == 1


def item_blocks(benchmark: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> list[Items]:
    return [block for block, _ in each_block(benchmark, least, block_bytes)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_tiles, tiled, item_tokens, coverage of every leak."""
    spark = docs.sparkSession
    prepare(spark)
    rows, out = texts(docs), None
    for block, only in each_block(benchmark, least, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = shared.value
            for b in batches:
                found = []
                buf, offs = K.string_buffers(b.column(1))
                keys = b.column(0)
                for lo, _, part, o in K.chunks(buf, offs):
                    tok, first = tokens(part, o)
                    for k, known in items.hits(tok, first).items():
                        for item, n, tiled, size in items.leaks(tok[first[k]:first[k + 1]], first[k], known, threshold):
                            found.append((keys[lo + k].as_py(), items.ids[item], n, tiled, size, tiled / size))
                if found:
                    kinds = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["doc_id", "item_id", "n_tiles", "tiled", "item_tokens", "coverage"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, n_tiles long, tiled long, item_tokens long, coverage double")
        if not only:  # a pass of its own
            part = written(part, "leaks-block")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no item leaks into, all columns unchanged."""
    spark = docs.sparkSession
    prepare(spark)
    at, schema = docs.columns.index(text_col), docs.schema
    for block, only in each_block(benchmark, least, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = shared.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                buf, offs = K.string_buffers(b.column(at))
                for lo, _, part, o in K.chunks(buf, offs):
                    tok, first = tokens(part, o)
                    for k, known in items.hits(tok, first).items():
                        keep[lo + k] = not items.any_leak(tok[first[k]:first[k + 1]], first[k], known, threshold)
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
        if not only:  # a pass of its own
            docs = written(docs, "clean-block")
            shared.unpersist()
    return docs
