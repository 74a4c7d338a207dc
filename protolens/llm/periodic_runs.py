"""Periodic runs of words: maximal stretches in which words ``q`` apart are identical.

1. Stretches.  A run of period q and length >= max(24, 3 q) holds windows of W words that occur again q <= W words
   further on, for the least W of 16, 32, 64... that is not below q.  Such window hashes mark the stretches that can
   hold a run; equal windows have equal hashes, so none is lost, and a collision only marks too much.  Text without
   repeats so close together needs no tree.
2. Trees.  The marked stretches of a run of documents, told apart by unique separators, get Ukkonen suffix trees of
   their words and of the reversal, with lowest common ancestors on the Euler tours (``suffix_tree``).
3. Lyndon roots.  For an order of the words and its reverse, the longest Lyndon word at a position ends where the next
   smaller suffix begins.  Every run has a root among these; each candidate is extended to the right in the tree of the
   text and to the left in the tree of the reversal, and is a run where the whole is long enough.

The first step reads texts as hashes, the trees hold word numbers given by the words themselves, so results are exact.
Memory of a task: the batch, and some 700 bytes a word of its longest marked stretch.

Edge cases: null and empty texts have no words and no run; repeated rows are judged one by one; other columns are
passed over; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from protolens.llm import kernel as K
from protolens.llm.common import prepare, texts
from protolens.llm.suffix_tree import Extensions, SuffixTree

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: words of marked stretches that share a tree; a longer stretch has one of its own
TREE_WORDS = 1 << 15

#: (doc_id, number of words) -> the word that stands at each place, or None for the text as it is
Order = Callable[[int | None, int], "np.ndarray | None"]


def _next_distance(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurs again, and the distance to the next such position."""
    by = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
    here, there = pos[by[same]], pos[by[same + 1]]
    return here, there - here


def marked_stretches(h: np.ndarray, first: np.ndarray, least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of word hashes that can hold a run; none crosses documents."""
    none = np.zeros(0, np.int64)
    if exponent < 3:
        raise ValueError("windows of doubling width find runs of exponent 3 or more")
    base = -(-least * (exponent - 1) // exponent)  # words that recur in the shortest run, whatever its period
    most = int(np.diff(first).max()) if len(first) > 1 else 0
    if most < least:
        return none, none
    cover = np.zeros(len(h) + 1, np.int64)
    docs = np.arange(len(first) - 1)
    size, words, bounds, shift = base, h, first, np.zeros(len(docs), np.int64)
    while size <= most:
        at, doc = K.window_docs(bounds, size)
        if not len(at):
            break
        window = K.window_hash(words, size)[at]
        here, far = _next_distance(K.mix(window ^ K.mix(doc.astype(np.uint64) + K.U64(1))), at)
        if not len(here):
            break  # longer windows cannot recur either
        near = far <= size
        which = np.searchsorted(bounds, here[near], side="right") - 1
        np.add.at(cover, here[near] + shift[which], 1)
        np.add.at(cover, here[near] + shift[which] + far[near] + size, -1)
        if size == base:  # longer windows only in documents where these recur
            keep = np.unique(np.searchsorted(bounds, here, side="right") - 1)
            lengths = np.diff(first)[keep]
            words = h[K.ragged(first[keep], lengths)]
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            shift = first[keep] - bounds[:-1]
            most = int(lengths.max())
        size *= 2
    inside = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):  # stretches that touch across documents are cut where a document begins
        cuts = np.concatenate([starts, first[np.isin(first, starts, invert=True)]])
        cuts = np.unique(cuts[(cuts >= starts[0]) & (cuts < ends[-1])])
        owner = np.searchsorted(starts, cuts, side="right") - 1
        held = cuts < ends[owner]
        cuts, owner = cuts[held], owner[held]
        stop = np.concatenate([cuts[1:], ends[-1:]])
        starts, ends = cuts, np.minimum(stop, ends[owner])
    return starts, ends


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """Next position with a smaller rank, len(rank) where there is none."""
    n = len(rank)
    out, stack = [n] * n, []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    return np.array(out, np.int64)


def runs_of(pieces: list[list[int]], least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """Runs (start, length, period), sorted by start and period, of each sequence of word numbers (from 0)."""
    seps = len(pieces) + 1  # separators are smaller than every word, in both orders
    s, begin = [0], []
    for k, piece in enumerate(pieces):
        begin.append(len(s))
        s += [w + seps for w in piece]
        s.append(k + 1)
    n = len(s)
    tree = SuffixTree(s)
    depths, at, rank = tree.tour()
    back_rank = tree.ranks(lambda c: c if c < seps else -c + (1 << 62))
    del tree
    right = Extensions(depths, at)
    depths, at, _ = SuffixTree(s[::-1]).tour()
    left = Extensions(depths, at)
    word = np.array(s) >= seps
    found = []
    for order in (rank, back_rank):
        stop = _next_smaller(order)
        i = np.flatnonzero(word)
        j = stop[i]
        ok = j < n
        ok[ok] &= word[j[ok]]  # a word up to the separator: a run's earlier root, followed by more of it, stands for it
        found.append(np.stack([i[ok], j[ok]]))
    i, j = np.unique(np.concatenate(found, axis=1), axis=1) if n else (np.zeros(0, np.int64),) * 2
    out: list[np.ndarray] = []
    if len(i):
        period = j - i
        start = i - left(n - i, n - j)
        length = j + right(i, j) - start
        ok = (length >= least) & (length >= exponent * period)
        rows = np.unique(np.stack([start[ok], period[ok], length[ok]], axis=1), axis=0)
    else:
        rows = np.zeros((0, 3), np.int64)
    owner = np.searchsorted(begin, rows[:, 0], side="right") - 1
    for k, b in enumerate(begin):
        mine = rows[owner == k]
        out.append(np.stack([mine[:, 0] - b, mine[:, 2], mine[:, 1]], axis=1))
    return out


def _grouped(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > a and total + size > TREE_WORDS:
            yield a, k
            a, total = k, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def _judge(order: Order | None, least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            buf, offs = K.string_buffers(b.column(1))
            for lo, hi, part, o in K.chunks(buf, offs):
                starts, ends, first = K.spans(part, o)
                h = K.hash_spans(part, starts, ends)
                moved: dict[int, np.ndarray] = {}
                if order is not None:
                    for k in range(hi - lo):
                        to = order(ids[lo + k], int(first[k + 1] - first[k]))
                        if to is not None:
                            moved[k] = to
                            h[first[k]:first[k + 1]] = h[first[k]:first[k + 1]][to]
                a, z = marked_stretches(h, first, least, exponent)
                owner = np.searchsorted(first, a, side="right") - 1
                words: dict[int, list[bytes]] = {}
                for k in {*owner.tolist(), *moved}:
                    words[k] = part[o[k]:o[k + 1]].tobytes().split()
                    if k in moved:
                        own = words[k]
                        words[k] = [own[x] for x in moved[k].tolist()]
                runs: dict[int, list[np.ndarray]] = {}
                for x, y in _grouped(z - a):
                    number: dict[bytes, int] = {}
                    pieces = [[number.setdefault(w, len(number)) for w in words[int(k)][i - first[k]:j - first[k]]]
                              for i, j, k in zip(a[x:y], z[x:y], owner[x:y])]
                    for q, rows in zip(range(x, y), runs_of(pieces, least, exponent)):
                        if len(rows):
                            rows[:, 0] += a[q] - first[owner[q]]
                            runs.setdefault(int(owner[q]), []).append(rows)
                n_runs, all_rows, kept = [], [], []
                for k in range(hi - lo):
                    mine = words.get(k)
                    if k in runs:
                        rows = np.concatenate(runs[k])
                        cover = np.zeros(len(mine) + 1, np.int64)
                        np.add.at(cover, rows[:, 0] + rows[:, 2], 1)
                        np.add.at(cover, rows[:, 0] + rows[:, 1], -1)
                        keep = np.cumsum(cover[:-1]) == 0
                        mine = [w for w, stay in zip(mine, keep.tolist()) if stay]
                        all_rows.append(rows)
                        n_runs.append(len(rows))
                    else:
                        n_runs.append(0)
                    if mine is None:
                        mine = part[o[k]:o[k + 1]].tobytes().split()
                    kept.append(b" ".join(mine))
                rows = np.concatenate(all_rows) if all_rows else np.zeros((0, 3), np.int64)
                fields = [pa.array(np.ascontiguousarray(rows[:, c]), pa.int64()) for c in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_runs)]), pa.int32()),
                                                 pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), lists,
                     pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, order: Order | None = None, least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> (by start, then period) and the text with each run cut
    to its first period (words joined by one space), for every document.  ``order`` may rearrange its words first."""
    prepare(docs.sparkSession)
    return texts(docs).mapInArrow(_judge(order, least, exponent), "doc_id long, n_words long, "
                                  "runs array<struct<start:long,length:long,period:long>>, collapsed string")
