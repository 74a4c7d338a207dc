"""Best-fit packing of token sequences by pattern packing with non-negative least squares.

1. Every document is tokenized where it lies (pre-token cache, no shuffle) and cut into pieces
   of at most ``max_tokens``; only lengths, checksums and positions go on (ids on request).
2. The histogram of piece lengths has at most ``max_tokens`` rows whatever the input size; it is
   the only thing the driver sees.  ``plan`` enumerates the patterns of up to three length classes
   that fill a sequence, fits their repeat counts to the histogram by non-negative least squares,
   rounds them down, realises them with exact lengths (the last place of a pattern takes the
   longest length that still fits), and packs what is left best-fit, longest first.
3. A piece's rank among the pieces of its length (count in earlier partitions + rank in its own)
   decides its sequence and offset; the plan is a list of rank intervals per length.

Edge cases: null and empty texts are the end id alone (one piece of length 1); repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolens.llm import kernel as K
from protolens.llm.common import prepare, texts, written
from protolens.llm.piece_cache import PieceCache

MAX_TOKENS = 2048
#: classes that the pattern fit tells apart in a sequence
CLASSES = 256
END_ID = 0
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARK, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_TOKENIZER: dict[str, object] = {}
_CACHE: dict[str, PieceCache] = {}


def _tokenizer(path: str):
    if path not in _TOKENIZER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task; Spark has the parallelism
        from tokenizers import Tokenizer

        _TOKENIZER[path] = Tokenizer.from_file(path)
    return _TOKENIZER[path]


def encode_pieces(path: str, pieces: list[bytes]) -> list[list[int]]:
    got = _tokenizer(path).encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
    return [g.ids for g in got]


def _cuts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that byte-level pre-tokenization never joins: each starts at a document's start or at
    ASCII white space after a character that is not white space."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = _SPACE[buf]
    head = space.copy()
    head[1:] &= ~space[:-1]
    at = np.flatnonzero(head)
    last = buf[at - 1]
    wide = np.flatnonzero((last >= 0x80) & (at >= 3))
    if len(wide):  # after a wide white space character the run goes on
        p = at[wide]
        x, y, z = buf[p - 3], buf[p - 2], buf[p - 1]
        blank = ((y == 0xC2) & ((z == 0x85) | (z == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80)
                 | (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
                 | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80))
        head[p[blank]] = False
    short = at[(at < 3) & (last >= 0x80)]
    head[short] = False  # too near the start to look back: stay joined
    # after an ASCII letter a mark of these always opens a pre-token of its own
    mark = np.flatnonzero(_MARK[buf[1:]] & _LETTER[buf[:-1]]) + 1
    head[mark] = True
    full = offs[:-1][np.diff(offs) > 0]
    head[full] = True
    starts = np.flatnonzero(head)
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, offs)


def document_ids(path: str, text: pa.Array, special: tuple[str, ...]):
    """Yield (row, ids) of each text, the end id included."""
    cache = _CACHE.get(path)
    if cache is None:
        cache = _CACHE[path] = PieceCache(lambda pieces: encode_pieces(path, pieces), keep_ids=True)
    buf, offs = K.string_buffers(text)
    marks = [s.encode() for s in special]
    for lo, hi, part, o in K.chunks(buf, offs):
        s, e, f = _cuts(part, o)
        row = cache.rows(part, s, e)
        size = cache.length[row]
        ids = cache.ids[K.ragged(cache.offset[row], size)]
        end = np.concatenate([[0], np.cumsum(size)])[f]
        raw = part.tobytes() if marks else b""
        odd = set()
        for m in marks:  # strings the library takes as added tokens: those documents go to it whole
            at = raw.find(m)
            while at >= 0:
                odd.add(int(np.searchsorted(o, at, side="right")) - 1)
                at = raw.find(m, at + 1)
        for k in range(hi - lo):
            if k in odd:
                own = np.array(_tokenizer(path).encode(text[lo + k].as_py(), add_special_tokens=False).ids, np.uint32)
            else:
                own = ids[end[k]:end[k + 1]]
            yield lo + k, np.append(own, np.uint32(END_ID))


def pieces_of(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """part, doc_id, piece, start, length, ids_crc32, rank in (part, length) and, on request, the ids."""
    prepare(docs.sparkSession)
    schema = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, place long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        part = TaskContext.get().partitionId()
        special = tuple(t.content for t in _tokenizer(tokenizer).get_added_tokens_decoder().values())
        seen = np.zeros(max_tokens + 1, np.int64)
        for b in batches:
            doc, piece, start, length, crc, place, out = [], [], [], [], [], [], []
            keys = b.column(0).to_pylist()
            for k, ids in document_ids(tokenizer, b.column(1), special):
                ids = ids.astype("<u4")
                cut = (len(ids) - 1) % max_tokens + 1
                for j, at in enumerate([0, *range(cut, len(ids), max_tokens)]):
                    own = ids[at:cut if not at else at + max_tokens]
                    doc.append(keys[k])
                    piece.append(j)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own.tobytes()))
                    place.append(int(seen[len(own)]))
                    seen[len(own)] += 1
                    if with_ids:
                        out.append(own.astype(np.int32))
            cols = [pa.array(np.full(len(doc), part, np.int32)), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(place, pa.int64())]
            names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "place"]
            if with_ids:
                cols.append(pa.array(out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return texts(docs).mapInArrow(run, schema)


def patterns(classes: int) -> np.ndarray:
    """All multisets of one to three classes that sum to ``classes`` exactly, padded with 0."""
    out = [(classes, 0, 0)]
    out += [(a, classes - a, 0) for a in range((classes + 1) // 2, classes)]
    out += [(a, b, classes - a - b) for a in range(-(-classes // 3), classes - 1) for b in range((classes - a + 1) // 2, min(a, classes - a - 1) + 1)]
    return np.array(out, dtype=np.int64)


def fit_nonnegative(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-3) -> np.ndarray:
    """min |a x - b| over x >= 0 by active sets (the classical method of Lawson and Hanson)."""
    m, n = a.shape
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    for _ in range(3 * m):
        gradient[free] = -np.inf
        k = int(np.argmax(gradient))
        if gradient[k] <= tolerance * max(1.0, float(np.abs(b).max())):
            break
        free[k] = True
        while True:
            on = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s > 0).all():
                break
            bad = s <= 0
            now = x[on]
            step = np.min(now[bad] / np.maximum(now[bad] - s[bad], 1e-12))
            x[on] = now + step * (s - now)
            drop = on[bad & (x[on] <= 1e-9)]
            drop = drop if len(drop) else on[[int(np.argmin(s))]]
            x[drop] = 0.0
            free[drop] = False
            if not free.any():
                s, on = np.zeros(0), np.zeros(0, np.int64)
                break
        x[:] = 0.0
        x[on] = s
        gradient = a.T @ (b - a @ x)
    return x


def plan(histogram: np.ndarray, max_tokens: int = MAX_TOKENS, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many sequences) for ``histogram[length]`` pieces of each length.

    Uses every piece exactly once.  The work depends on ``max_tokens`` and ``classes``, not on the counts."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    classes = min(classes, max_tokens)
    unit = -(-max_tokens // classes)
    classes = -(-max_tokens // unit)

    def longest(top: int) -> int:
        at = np.flatnonzero(left[1:top + 1]) if top > 0 else ()
        return int(at[-1]) + 1 if len(at) else 0

    def use(lengths: list[int], most: int | None = None) -> int:
        got, need = np.unique(lengths, return_counts=True)
        n = int((left[got] // need).min())
        n = n if most is None else min(n, most)
        if n > 0:
            left[got] -= n * need
            out.append((tuple(int(v) for v in lengths), n))
        return n

    if left[max_tokens]:
        use([max_tokens])
    of = (np.arange(max_tokens + 1) + unit - 1) // unit
    b = np.bincount(of, weights=left, minlength=classes + 1)[1:classes + 1]
    if b.sum():
        shapes = patterns(classes)
        a = np.zeros((classes, len(shapes)))
        for j in range(3):
            has = np.flatnonzero(shapes[:, j])
            np.add.at(a, (shapes[has, j] - 1, has), 1.0)
        times = np.floor(fit_nonnegative(a, b) + 1e-6).astype(np.int64)
        for k in np.argsort(-shapes[:, 0], kind="stable"):
            todo, shape = int(times[k]), [int(c) for c in shapes[k] if c]
            while todo > 0:
                lengths, room = [], max_tokens
                for c in shape[:-1]:
                    taken = [left[v] - lengths.count(v) for v in range((c - 1) * unit + 1, min(c * unit, max_tokens) + 1)]
                    best = next((v for v in range(len(taken) - 1, -1, -1) if taken[v] > 0), None)
                    if best is None:
                        break
                    lengths.append((c - 1) * unit + 1 + best)
                    room -= lengths[-1]
                else:
                    last = longest(room)
                    while last and left[last] <= lengths.count(last):
                        last = longest(last - 1)
                    if not last:
                        break
                    n = use([*lengths, last], todo)
                    if not n:
                        break
                    todo -= n
                    continue
                break
    while (first := longest(max_tokens)):
        lengths, room = [first], max_tokens - first
        while room > 0:
            v = longest(room)
            while v and left[v] <= lengths.count(v):
                v = longest(v - 1)
            if not v:
                break
            lengths.append(v)
            room -= v
        use(lengths)
    return out


def _intervals(made: list[tuple[tuple[int, ...], int]], max_tokens: int) -> dict[str, np.ndarray]:
    """The plan by length: (first rank, sequence of the first rank, offset), sorted by (length, rank)."""
    used = np.zeros(max_tokens + 1, np.int64)
    rows, base = [], 0
    for lengths, n in made:
        at = 0
        for v in lengths:
            rows.append((v, int(used[v]), base, at))
            used[v] += n
            at += v
        base += n
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    prepare(docs.sparkSession)
    pieces = written(pieces_of(docs, tokenizer, max_tokens, with_ids), "pack-pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    found = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row a length: at most max_tokens
    histogram = np.zeros(max_tokens + 1, np.int64)
    for r in found:
        histogram[r["length"]] = r["n"]
    at = _intervals(plan(histogram, max_tokens), max_tokens)
    edges = np.searchsorted(at["length"], np.arange(max_tokens + 2))

    def place(batches):
        for b in batches:
            length = np.asarray(b.column("length")).astype(np.int64)
            rank = np.asarray(b.column("rank"))
            row = np.zeros(len(length), np.int64)
            for v in np.unique(length):
                own = np.flatnonzero(length == v)
                lo, hi = edges[v], edges[v + 1]
                row[own] = lo + np.searchsorted(at["rank"][lo:hi], rank[own], side="right") - 1
            seq = at["sequence"][row] + rank - at["rank"][row]
            keep = [b.column(c) for c in ("doc_id", "piece", "start")] + [pa.array(length), b.column("ids_crc32"), pa.array(seq), pa.array(at["offset"][row])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                keep.append(b.column("ids"))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(keep, names)

    ranked = (pieces.join(before.select("part", "length", "before"), ["part", "length"])
              .withColumn("rank", F.col("place") + F.coalesce("before", F.lit(0))).drop("part", "place", "before"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return ranked.mapInArrow(place, schema)
