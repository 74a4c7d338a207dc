"""Substring deduplication by difference-cover anchors.

A window is ``LENGTH`` consecutive words of one document.  A word goes when a window over it also starts
in a document with a smaller doc_id.

Copies of a whole text repeat it in every window, so all but the first are settled by the text's digest and take
no part in what follows.

1. Anchors.  Shorter windows of ``LENGTH - PERIOD + 1`` words are hashed only where their position modulo
   ``PERIOD`` lies in a difference cover (a set whose differences give every residue; 6 of 31).  Wherever two
   documents share a whole window, some offset below ``PERIOD`` puts both positions on the cover, so they
   share an anchor inside it.  Anchors seen in one text only are done with: most of the words.
2. Extension.  In documents with shared anchors the windows that contain one are hashed in full (128
   bits).  Each task settles what it can see (all but the smallest document of a window are repeats; windows
   found in several documents are remembered), so a passage that a third of all documents hold leaves
   about one row a task; the rest meet in one shuffle sorted by hash, streamed with the memory of one batch.
3. Removal.  The repeated windows of each document are joined to its text and their words dropped.

Edge cases: null texts have no words; windows are judged on the input; repeats inside one document stay;
rows with one doc_id are one document (none is smaller than the other); a null doc_id is neither
smaller nor larger than any, so its rows stay whole; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.llm import kernel as K
from protolens.llm.common import partitions, prepare, release, texts, written

LENGTH = 50
PERIOD = 31
#: windows of several documents that a task remembers; past it the memory starts anew (it decides rows shuffled, not results)
REMEMBERED = 1 << 20
#: bytes of text whose windows are settled together before the shuffle
SETTLED_BYTES = 4 << 20


def difference_cover(period: int) -> tuple[int, ...]:
    """Smallest set with 0 and 1 whose differences modulo ``period`` are all residues (by search)."""
    if period < 3:
        return tuple(range(period))
    for size in range(2, period + 1):
        if size * (size - 1) + 1 < period:
            continue
        for rest in combinations(range(2, period), size - 2):
            cover = (0, 1, *rest)
            if len({(x - y) % period for x in cover for y in cover}) == period:
                return cover
    return tuple(range(period))


class Layout:
    """Window length, period and cover, and the anchors they give."""

    def __init__(self, length: int = LENGTH, period: int = PERIOD):
        self.length, self.period = length, min(period, length)
        self.anchor = self.length - self.period + 1
        self.on = np.zeros(self.period, bool)
        self.on[list(difference_cover(self.period))] = True

    def words(self, buf: np.ndarray, offs: np.ndarray, seed: int = 17):
        s, e, first = K.spans(buf, offs)
        return s, e, first, K.hash_spans(buf, s, e, seed)

    def anchors(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, word index) of the anchors of a run of documents, in order."""
        every = K.mix(K.window_hash(h, self.anchor, salt=3))
        at, doc = K.window_docs(first, self.anchor)
        use = self.on[(at - first[doc]) % self.period] & (np.diff(first)[doc] >= self.length)
        return every[at[use]], doc[use], at[use]


def _anchor_rows(layout: Layout):
    def run(batches):
        for b in batches:
            ids = np.asarray(b.column(0).fill_null(0))
            known = np.asarray(b.column(0).is_valid())
            buf, offs = K.string_buffers(b.column(1))
            for lo, _, part, o in K.chunks(buf, offs):
                _, _, first, h = layout.words(part, o)
                a, doc, _ = layout.anchors(h, first)
                order = np.lexsort((a, doc))
                a, doc = a[order], doc[order]
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]) if len(a) else np.zeros(0, bool)
                a, doc = a[new], doc[new] + lo
                a, doc = a[known[doc]], doc[known[doc]]
                whole = K.hash_spans(part, o[:-1], o[1:], seed=29)[doc - lo]  # tells texts apart, not documents
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(a)), pa.array(ids[doc]), pa.array(K.signed(whole))], ["h", "doc_id", "t"])

    return run


def _variant(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "little", signed=True)


class Seen:
    """Smallest document so far of the windows that a task met in several documents."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.pool, self.y, self.low = K.HashPool(), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def settle(self, x: np.ndarray, y: np.ndarray, low: np.ndarray, several: np.ndarray) -> np.ndarray:
        """Smallest documents of distinct windows, what earlier calls saw included; ``several`` marks those to remember."""
        row = self.pool.find(x)
        known = row >= 0
        known[known] = self.y[row[known]] == y[known]  # another window with the same first hash is left alone
        out = low.copy()
        out[known] = np.minimum(low[known], self.low[row[known]])
        self.low[row[known]] = out[known]
        new = np.flatnonzero(several & (row < 0))
        new = new[np.unique(x[new], return_index=True)[1]]
        if len(new):
            if self.pool.size > REMEMBERED:
                self.clear()
            at = np.arange(len(self.low), len(self.low) + len(new), dtype=np.int32)
            self.pool.add(x[new], at)
            self.y, self.low = np.concatenate([self.y, y[new]]), np.concatenate([self.low, out[new]])
        return out


def _window_rows(layout: Layout, tell_apart: bool):
    """Of documents with shared anchors (doc_id, text, anchors): open windows (kind 0) and settled repeats (kind 1)."""

    def run(batches):
        seen = Seen()
        for b in batches:
            ids = np.asarray(b.column(0))
            buf, offs = K.string_buffers(b.column(1))
            shared = b.column(2)
            flat = np.asarray(shared.flatten()).view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(np.asarray(shared.value_lengths()))])
            for lo, hi, part, o in K.chunks(buf, offs, SETTLED_BYTES):
                _, _, first, h = layout.words(part, o)
                again = K.hash_spans(part, *K.spans(part, o)[:2], seed=18)
                a, doc, at = layout.anchors(h, first)
                # an anchor counts when its own document's list holds it: compare (document, hash) pairs
                own = flat[ends[lo]:ends[hi]]
                of = np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1]))
                want = np.sort(K.mix(own ^ K.mix(of.astype(np.uint64) + K.U64(1))))
                have = K.mix(a ^ K.mix(doc.astype(np.uint64) + K.U64(1)))
                hit = at[want[np.minimum(np.searchsorted(want, have), len(want) - 1)] == have] if len(want) and len(have) else at[:0]
                hit_doc = np.searchsorted(first, hit, side="right") - 1
                # windows that contain a shared anchor, clipped to the document
                begin = np.maximum(hit - layout.period + 1, first[hit_doc])
                end = np.minimum(hit, first[hit_doc + 1] - layout.length) + 1
                cover = np.zeros(len(h) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, end, -1)
                at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                if not len(at):
                    continue
                doc = np.searchsorted(first, at, side="right") - 1
                x, y = K.window_hash(h, layout.length, salt=5)[at], K.window_hash(again, layout.length, salt=7)[at]
                who = ids[lo + doc]
                variant = np.zeros(hi - lo, np.int32)
                if tell_apart:
                    for k in np.unique(doc):
                        variant[k] = _variant(part[o[k]:o[k + 1]].tobytes())
                order = np.lexsort((who, y, x))
                at, doc, x, y, who = at[order], doc[order], x[order], y[order], who[order]
                new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                each, of = np.flatnonzero(new), np.cumsum(new) - 1
                last = np.append(each[1:], len(new)) - 1
                low = seen.settle(x[each], y[each], who[each], who[last] != who[each])[of]
                kind = (who > low).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind), pa.array(K.signed(x)), pa.array(K.signed(y)), pa.array(who), pa.array(variant[doc]), pa.array((at - first[doc]).astype(np.int32))],
                    ["kind", "x", "y", "doc_id", "variant", "pos"])

    return run


def _repeats(batches):
    """Of windows sorted by (x, y, doc_id): the rows that are not of their window's smallest document."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        x, y, who = (np.asarray(b.column(k)) for k in range(3))
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        low = who[np.flatnonzero(new)][np.cumsum(new) - 1]
        if held is not None and (x[0], y[0]) == held[:2]:
            low[np.cumsum(new) == 1] = held[2]
        held = (x[-1], y[-1], low[-1])
        keep = who != low
        if keep.any():
            yield b.select(["doc_id", "variant", "pos"]).filter(pa.array(keep))


def _removed(layout: Layout, tell_apart: bool, with_text: bool):
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words) of (doc_id, text, repeats, copy)."""

    def run(batches):
        for b in batches:
            buf, offs = K.string_buffers(b.column(1))
            lists, copy = b.column(2), np.asarray(b.column(3))
            n_words, n_removed, digest, kept_text = [], [], [], []
            for lo, hi, part, o in K.chunks(buf, offs):
                s, e, first = K.spans(part, o)
                space = np.concatenate([part, np.array([0x20], np.uint8)])
                for k in range(hi - lo):
                    i, j = int(first[k]), int(first[k + 1])
                    a, z = s[i:j], e[i:j]
                    keep = np.ones(j - i, bool)
                    if copy[lo + k]:
                        keep[:] = len(keep) < layout.length
                    found = lists[lo + k].as_py() if lists[lo + k].is_valid else None
                    if found:
                        own = _variant(part[o[k]:o[k + 1]].tobytes()) if tell_apart else 0
                        at = np.array([f["pos"] for f in found if f["variant"] == own], np.int64)
                        at = at[at + layout.length <= j - i]  # a null text may share its doc_id with another
                        cover = np.zeros(j - i + 1, np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + layout.length, -1)
                        keep &= np.cumsum(cover[:-1]) == 0
                    a, z = a[keep], z[keep]
                    # each kept word with the byte after it, that byte made a space
                    size = z - a + 1
                    out = space[np.minimum(K.ragged(a, size), len(space) - 1)]
                    if len(size):
                        out[np.cumsum(size) - 1] = 0x20
                    raw = out[:-1].tobytes()
                    n_words.append(j - i)
                    n_removed.append(j - i - len(a))
                    digest.append(hashlib.sha256(raw).hexdigest())
                    if with_text:
                        kept_text.append(raw.decode("utf-8", "replace"))
            cols = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept_text, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and its kept words on request."""
    spark = docs.sparkSession
    prepare(spark)
    layout, parts, rows = Layout(length, period), partitions(spark), texts(docs)

    # rows that share a doc_id but not the text are told apart by a text hash; without such rows it is left out
    digests = rows.where("doc_id is not null and text is not null").select("doc_id", F.md5("text").alias("digest"))
    digests = written(digests, "dedup-digests")
    twice = digests.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    tell_apart = not twice.where("lo <> hi").isEmpty()
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    copies = written(digests.join(firsts, "digest").where("doc_id <> first").select("doc_id", "digest").distinct(), "dedup-copies")

    anchors = written(rows.mapInArrow(_anchor_rows(layout), "h long, doc_id long, t long"), "dedup-anchors")
    several = anchors.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("h")
    lists = anchors.select("h", "doc_id").join(several, "h").groupBy("doc_id").agg(F.collect_list("h").alias("shared"))
    if not tell_apart:  # else a doc_id may name a copy and another text
        lists = lists.join(copies.select("doc_id"), "doc_id", "left_anti")
    lists = written(lists, "dedup-shared")
    release(spark)

    windows = (rows.join(lists.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "shared")
               .mapInArrow(_window_rows(layout, tell_apart), "kind int, x long, y long, doc_id long, variant int, pos int"))
    windows = written(windows, "dedup-windows")
    release(spark)
    open_ = windows.where("kind = 0").select("x", "y", "doc_id", "variant", "pos")
    met = open_.repartition(parts, "x").sortWithinPartitions("x", "y", "doc_id").mapInArrow(_repeats, "doc_id long, variant int, pos int")
    found = (met.unionByName(windows.where("kind = 1").select("doc_id", "variant", "pos"))
             .groupBy("doc_id").agg(F.collect_list(F.struct("variant", "pos")).alias("repeats")))
    found = written(found, "dedup-repeats")
    release(spark)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    if tell_apart:  # one row for each text of a doc_id
        own = rows.join(found.hint("shuffle_hash"), "doc_id", "left").withColumn("digest", F.md5("text"))
        marks = copies.select(F.col("doc_id").alias("of"), F.col("digest").alias("same"))
        all_ = own.join(marks, (F.col("doc_id") == F.col("of")) & (F.col("digest") == F.col("same")), "left")
        all_ = all_.withColumn("copy", F.col("same").isNotNull())
    else:
        named = found.join(copies, "doc_id", "full_outer")
        all_ = rows.join(named.hint("shuffle_hash"), "doc_id", "left").withColumn("copy", F.col("digest").isNotNull())
    return all_.select("doc_id", "text", "repeats", "copy").mapInArrow(_removed(layout, tell_apart, with_text), schema)
