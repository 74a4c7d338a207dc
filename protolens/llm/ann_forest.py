"""Approximate nearest neighbours by largest inner product with a hash-prefix forest.

1. Inner product becomes an angle: vectors get one more component sqrt(M^2 - |x|^2) (M the largest norm),
   queries a 0 there.
2. Each of ``trees`` trees gives every vector a string of ``BITS`` signs of random projections; a tree is the
   sorted array of these strings.  It lies in cells, ranges of common prefix that a bounded sample splits
   until each should hold at most ``cell`` vectors; cells have different depths.  Every vector is in
   every tree.
3. Probe: some ``PROBES`` queries are compared with every entry.  The smallest budget, ``budget`` or more, with
   which the ascent meets ``RECALL`` of their true neighbours is the table's; cells grow with it.
4. Descend: a query goes to its cell of each tree and counts there, prefix by prefix, how many entries
   agree with it on at least that many bits (only strings are shuffled for this); the sizes of the other
   cells tell how many agree on prefixes that are shorter than the cell's.
5. Ascend: all trees go up together, one bit at a time from the longest prefix, to the root if need be, until
   the entries found in all trees are the budget or more; the prefix length this gives is the query's.
6. Score: the query goes to every cell that its prefix meets; entries that agree on the prefix are scored
   there, the best of each cell are merged, and these are scored again in double precision on the
   original vectors.

Equal vectors are one entry; the ``k + 1`` smallest ids of each stand for it, which no answer can exceed.
Near-equal vectors that no prefix tells apart are dealt over sub-cells of ``SUB`` cells' size; a query goes to all
of them.  Work is queries x budget (more for near-equal vectors), memory one cell or sub-cell.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and null ids, take
no part; of rows with one id the vector with the smallest digest counts; vectors meet only those of
their own length; fewer candidates than ``k`` give fewer rows; other columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolens.llm import kernel as K
from protolens.llm.common import partitions, prepare, written

BITS = 64
TREES = 36
CELL = 2048
#: entries, over all trees, from which the ascent stops at the earliest
BUDGET = 32_768
#: share of the probes' true neighbours that the budget must reach, and about how many queries are probes
RECALL = 0.95
PROBES = 128
#: cells' sizes to a sub-cell of vectors that no bit tells apart
SUB = 16
SAMPLE = 20_000
#: candidates kept beyond k before the exact scores
SPARE = 16


def projections(dim: int, trees: int) -> np.ndarray:
    """(dim + 1) x (trees * BITS) normal directions, the same on every machine."""
    return np.random.default_rng([dim, 97]).standard_normal((dim + 1, trees * BITS), dtype=np.float32)


def codes(x: np.ndarray, extra: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings as big-endian numbers, rows x trees."""
    out = np.empty((len(x), trees), np.uint64)
    full = np.concatenate([x, extra[:, None]], axis=1).astype(np.float32)
    for a in range(0, len(x), 2048):
        bits = (full[a:a + 2048] @ planes) > 0
        out[a:a + 2048] = np.packbits(bits.reshape(-1, trees, BITS), axis=-1).view(">u8")[..., 0]
    return out


def prefix_range(code: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """First and last string that agree with ``code`` on ``level`` bits."""
    level = np.asarray(level).astype(np.uint64)
    away = np.minimum(K.U64(BITS) - level, K.U64(BITS - 1))
    low = np.where(level == 0, K.U64(0), code >> away << away)
    return low, np.where(level == 0, ~K.U64(0), low | ((K.U64(1) << away) - K.U64(1)))


def split_cells(sample: np.ndarray, rows_each: float, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """(first string, sub-cells) of the cells of one tree, from its sorted sample strings."""
    starts, parts = [], []
    todo = [(0, len(sample), 0, 0)]
    while todo:
        lo, hi, depth, start = todo.pop()
        expected = (hi - lo) * rows_each
        while expected > cell and hi - lo > 1 and depth < BITS:
            bit = 1 << (BITS - 1 - depth)
            base = int(sample[lo]) >> (BITS - depth) << (BITS - depth) if depth else 0
            mid = int(np.searchsorted(sample[lo:hi], np.uint64(base | bit))) + lo
            depth += 1
            if lo < mid < hi:
                todo.append((mid, hi, depth, base | bit))
                hi = mid
                expected = (hi - lo) * rows_each
        starts.append(start)
        parts.append(max(1, int(np.ceil(expected / (SUB * cell)))))
    order = np.argsort(np.array(starts, dtype=np.uint64))
    return np.array(starts, dtype=np.uint64)[order], np.array(parts, dtype=np.int64)[order]


class Forest:
    """What the executors need: per vector length the largest norm, the budget, and the cells of every tree and
    how many entries lie before each."""

    def __init__(self, trees: int):
        self.trees, self.norm, self.shift, self.budget, self.cells, self.before, self._planes = trees, {}, {}, {}, {}, {}, {}

    def planes(self, dim: int) -> np.ndarray:
        if dim not in self._planes:
            self._planes[dim] = projections(dim, self.trees)
        return self._planes[dim]

    def __getstate__(self):
        return {**self.__dict__, "_planes": {}}

    def scaled(self, dim: int, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors by a power of two, so that 32-bit floats hold them: entries by the table's largest norm, a query by its own
        largest component (its order of candidates is the same at any scale)."""
        return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None] if query else -self.shift[dim])

    def strings(self, dim: int, x: np.ndarray, query: bool) -> np.ndarray:
        square = self.norm[dim] ** 2 - (x.astype(np.float64) ** 2).sum(1)
        return codes(x, np.zeros(len(x)) if query else np.sqrt(np.maximum(square, 0.0)), self.planes(dim), self.trees)

    def place(self, dim: int, x: np.ndarray, ids: np.ndarray):
        """Yield (tree, row, string, cell, sub-cell) of entries, each in one sub-cell of every tree."""
        c = self.strings(dim, x, False)
        for t in range(self.trees):
            starts, parts = self.cells[dim][t]
            cell = np.searchsorted(starts, c[:, t], side="right") - 1
            salt = K.mix(ids.astype(np.uint64) + K.U64(t * 0x9E3779B9)) % parts[cell].astype(np.uint64)
            yield t, np.arange(len(x)), c[:, t], cell.astype(np.int32), salt.astype(np.int32)

    def seek(self, dim: int, x: np.ndarray, level):
        """Yield (tree, row, string, cell, sub-cell) of queries, in all sub-cells that their prefixes of ``level`` bits meet."""
        c = self.strings(dim, x, True)
        for t in range(self.trees):
            starts, parts = self.cells[dim][t]
            low, high = prefix_range(c[:, t], level)
            first = np.searchsorted(starts, low, side="right") - 1
            width = np.searchsorted(starts, high, side="right") - first
            row, cell = np.repeat(np.arange(len(x)), width), K.ragged(first, width)
            n = parts[cell]
            row, cell, salt = np.repeat(row, n), np.repeat(cell, n), K.ragged(np.zeros(len(n), np.int64), n)
            yield t, row, c[row, t], cell.astype(np.int32), salt.astype(np.int32)

    def beyond(self, dim: int, tree: int, cell: int, code: np.ndarray) -> np.ndarray:
        """Entries of the other cells that agree on at least 0, 1, ... BITS bits (cells that lie wholly in the prefix)."""
        starts, before = self.cells[dim][tree][0], self.before[dim][tree]
        ends = np.append(starts[1:] - K.U64(1), ~K.U64(0))
        low, high = prefix_range(code[:, None], np.arange(BITS + 1)[None, :])
        first, last = np.searchsorted(starts, low, side="left"), np.searchsorted(ends, high, side="right")
        own = np.where((first <= cell) & (cell < last), before[cell + 1] - before[cell], 0)
        return np.where(last > first, before[last] - before[first], 0) - own


def _vectors(col: pa.Array) -> np.ndarray:
    buf, offs = K.string_buffers(col)
    return np.frombuffer(buf[offs[0]:offs[-1]].tobytes(), "<f8").reshape(len(offs) - 1, -1)


def _by_dim(batch: pa.RecordBatch, at: int):
    """Parts of a batch with vectors of one length: (rows, length)."""
    _, offs = K.string_buffers(batch.column(at))
    size = np.diff(offs) // 8
    for dim in np.unique(size):
        yield np.flatnonzero(size == dim), int(dim)


def packed(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, key): one valid vector of each id as little-endian doubles, and its digest."""
    v = F.col(vec_col).cast("array<double>")
    good = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("a")).where(
        F.col("vec_id").isNotNull() & F.col("a").isNotNull() & (F.size("a") > 0)
        & F.forall("a", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        & F.exists("a", lambda c: c != 0.0))

    def run(batches):
        for b in batches:
            a = b.column(1)
            flat = np.asarray(a.flatten()).astype("<f8") + 0.0
            ends = np.concatenate([[0], np.cumsum(np.asarray(a.value_lengths()))]).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[x:y].tobytes() for x, y in zip(ends, ends[1:])], pa.binary())], ["vec_id", "v"])

    rows = good.mapInArrow(run, "vec_id long, v binary").withColumn("key", F.md5("v"))
    return rows.groupBy("vec_id").agg(F.min_by("v", "key").alias("v"), F.min("key").alias("key"))


def fit(entries: DataFrame, trees: int, cell: int, budget: int, k: int, sample: int = SAMPLE) -> Forest:
    """Cells from about ``sample`` vectors; norms and cell sizes from all; the budget from probes."""

    def norms(batches):
        for b in batches:
            for rows, dim in _by_dim(b, 1):
                x, asks = _vectors(b.column(1).take(pa.array(rows))), np.asarray(b.column(2).take(pa.array(rows)))
                e = int(np.frexp(np.abs(x).max())[1])
                norm = e + float(np.log2(np.sqrt((np.ldexp(x, -e) ** 2).sum(1)).max()))  # squares of the vectors themselves may overflow
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([int(asks.sum())], pa.int64()), pa.array([norm])], ["dim", "n", "asks", "norm"])

    forest = Forest(trees)
    stats = entries.select("rep", "v", "asks").mapInArrow(norms, "dim int, n long, asks long, norm double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("asks").alias("asks"), F.max("norm").alias("norm")).collect()  # one row a length
    total = sum(r["n"] for r in stats)
    share = 1.0 if total <= sample else sample / total
    drawn = entries.where(F.pmod(F.xxhash64("rep", F.lit(41)), F.lit(1 << 30)) < int(share * (1 << 30))).select("rep", "v").toArrow()  # about ``sample`` vectors
    by_dim, drawn_codes = {}, {}
    for batch in drawn.to_batches():
        for rows, dim in _by_dim(batch, 1):
            by_dim.setdefault(dim, []).append(_vectors(batch.column(1).take(pa.array(rows))))
    for r in stats:
        dim, forest.shift[r["dim"]] = r["dim"], int(np.floor(r["norm"])) + 1
        forest.norm[dim] = 2.0 ** (r["norm"] - forest.shift[dim])
        x = forest.scaled(dim, np.concatenate(by_dim[dim]), False).astype(np.float32) if dim in by_dim else np.zeros((0, dim), np.float32)
        square = forest.norm[dim] ** 2 - (x.astype(np.float64) ** 2).sum(1)
        c = np.sort(codes(x, np.sqrt(np.maximum(square, 0.0)), forest.planes(dim), trees), axis=0)
        drawn_codes[dim] = c, r["n"] / max(len(x), 1)
        forest.cells[dim] = [split_cells(c[:, t], drawn_codes[dim][1], cell) for t in range(trees)]
    sizes, reach = probe(entries, forest, {r["dim"]: r["asks"] for r in stats}, k)
    for dim, (c, each) in drawn_codes.items():
        forest.budget[dim] = budget_for(*reach[dim], budget, trees * sum(sizes[dim][0])) if dim in reach else budget
        wider, forest.before[dim] = max(cell, -(-forest.budget[dim] // trees)), []
        for t in range(trees):
            old, forest.cells[dim][t] = forest.cells[dim][t][0], split_cells(c[:, t], each, wider)
            upto = np.concatenate([[0], np.cumsum(sizes[dim][t])])
            forest.before[dim].append(np.append(upto[np.searchsorted(old, forest.cells[dim][t][0])], upto[-1]))  # wider cells are unions
    return forest


def budget_for(total: np.ndarray, reached: list[np.ndarray], budget: int, most: int) -> int:
    """The smallest budget that meets ``RECALL`` of the probes' neighbours.

    ``total``: entries by probe and prefix length; ``reached``: the longest prefix shared with each neighbour."""
    goal = sum(len(r) for r in reached) * RECALL
    while budget < most:
        level = np.maximum((total >= budget).sum(1) - 1, 0)  # totals fall with the length
        if sum(int((r >= b).sum()) for r, b in zip(reached, level)) >= goal:
            break
        budget = min(most, int(budget * 1.25) + 1)
    return budget


def probe(entries: DataFrame, forest: Forest, asks: dict[int, int], k: int) -> tuple[dict, dict]:
    """Cell sizes by length and tree; by length the totals and prefixes that ``budget_for`` takes, of about ``PROBES`` queries."""
    lot = F.pmod(F.xxhash64("rep", F.lit(43)), F.lit(1 << 30))
    some = F.lit(False)
    for dim, n in asks.items():
        some = some | ((F.octet_length("v") == 8 * dim) & (lot < int(min(1.0, PROBES / max(n, 1)) * (1 << 30))))
    drawn = entries.where(F.col("asks") == 1).where(some).select("rep", "v").toArrow()  # about PROBES vectors a length
    probes = {}
    for batch in drawn.to_batches():
        for rows, dim in _by_dim(batch, 1):
            some = pa.array(rows)
            probes.setdefault(dim, []).append((np.asarray(batch.column(0).take(some)), forest.scaled(dim, _vectors(batch.column(1).take(some)), True)))
    probes = {d: tuple(np.concatenate(x) for x in zip(*parts)) for d, parts in probes.items()}
    shared = entries.sparkSession.sparkContext.broadcast((forest, probes))

    def run(batches):
        forest, probes = shared.value
        size = {d: [np.zeros(len(s), np.int64) for s, _ in cells] for d, cells in forest.cells.items()}
        code = {d: forest.strings(d, x, True) for d, (_, x) in probes.items()}
        total = {d: np.zeros((len(x), BITS + 1), np.int64) for d, (_, x) in probes.items()}
        best = {d: [[] for _ in x] for d, (_, x) in probes.items()}
        for b in batches:
            for rows, dim in _by_dim(b, 1):
                for a in range(0, len(rows), 8192):
                    part = pa.array(rows[a:a + 8192])
                    x, ids = forest.scaled(dim, _vectors(b.column(1).take(part)), False), np.asarray(b.column(0).take(part))
                    c = forest.strings(dim, x, False)
                    for t in range(forest.trees):
                        starts = forest.cells[dim][t][0]
                        size[dim][t] += np.bincount(np.searchsorted(starts, c[:, t], side="right") - 1, minlength=len(starts))
                        if dim in probes:
                            low, high = prefix_range(code[dim][:, t, None], np.arange(BITS + 1)[None, :])
                            line = np.sort(c[:, t])
                            total[dim] += np.searchsorted(line, high, side="right") - np.searchsorted(line, low, side="left")
                    for q, s in enumerate(probes[dim][1] @ x.T if dim in probes else []):
                        top = np.argpartition(-s, min(k, len(s) - 1))[:k + 1]
                        away = (c[top] ^ code[dim][q]).min(1)  # of the tree that agrees on most bits
                        now = best[dim][q] + [(-float(s[i]), int(ids[i]), BITS - int(w).bit_length()) for i, w in zip(top, away)]
                        best[dim][q] = sorted(now)[:k + 1]
        out = [(d, 0, t, c, int(n), 0.0) for d, by in size.items() for t, x in enumerate(by) for c, n in enumerate(x) if n]
        out += [(d, 1, q, b, int(n), 0.0) for d, x in total.items() for q, by in enumerate(x) for b, n in enumerate(by) if n]
        out += [(d, 2, q, b, i, s) for d, by in best.items() for q, x in enumerate(by) for s, i, b in x]
        if out:
            kinds = [pa.int32()] * 4 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["dim", "what", "a", "b", "n", "minus"])

    seen = written(entries.select("rep", "v").mapInArrow(run, "dim int, what int, a int, b int, n long, minus double"), "ann-probes")
    size = {d: [np.zeros(len(s), np.int64) for s, _ in cells] for d, cells in forest.cells.items()}
    total = {d: np.zeros((len(x), BITS + 1), np.int64) for d, (_, x) in probes.items()}
    reached = {d: [np.zeros(0, np.int64)] * len(x) for d, (_, x) in probes.items()}
    for r in seen.where("what < 2").groupBy("dim", "what", "a", "b").agg(F.sum("n").alias("n")).collect():  # one row a cell, PROBES x BITS more
        if r["what"]:
            total[r["dim"]][r["a"], r["b"]] = r["n"]
        else:
            size[r["dim"]][r["a"]][r["b"]] = r["n"]
    near = F.slice(F.array_sort(F.collect_list(F.struct("minus", "n", "b"))), 1, k + 1)
    for r in seen.where("what = 2").groupBy("dim", "a").agg(near.alias("near")).collect():
        own = probes[r["dim"]][0][r["a"]]
        reached[r["dim"]][r["a"]] = np.array([x["b"] for x in r["near"] if x["n"] != own][:k], np.int64)
    return size, {d: (total[d], reached[d]) for d in probes}


def _descend(shared):
    def run(key, group):
        """Per query of a cell, how many entries agree on at least 0, 1, ... BITS bits; the first sub-cell adds the other cells."""
        dim, tree, cell, salt = (x.as_py() for x in key)
        kind = np.asarray(group.column("kind").combine_chunks())
        code = np.asarray(group.column("code").combine_chunks()).view(np.uint64)
        entry, ask = np.sort(code[kind == 0]), code[kind == 1]
        low, high = prefix_range(ask[:, None], np.arange(BITS + 1)[None, :])
        out = (np.searchsorted(entry, high, side="right") - np.searchsorted(entry, low, side="left")).astype(np.int64)
        if not salt:
            out += shared.value.beyond(dim, tree, cell, ask)
        ids = group.column("id").combine_chunks().filter(pa.array(kind == 1))
        return pa.table({"id": ids, "dim": pa.array(np.full(len(ask), dim, np.int32)), "counts": pa.array([row.tobytes() for row in out], pa.binary())})

    return run


def _score(best: int):
    def run(key, group):
        dim = key[0].as_py()
        kind = np.asarray(group.column("kind").combine_chunks())
        code = np.asarray(group.column("code").combine_chunks()).view(np.uint64)
        ids = np.asarray(group.column("id").combine_chunks())
        v = group.column("v").combine_chunks()
        buf, offs = K.string_buffers(v)
        x = np.frombuffer(buf[offs[0]:offs[-1]].tobytes(), "<f4").reshape(-1, dim)
        e = np.flatnonzero(kind == 0)
        e = e[np.argsort(code[e], kind="stable")]
        q = np.flatnonzero(kind == 1)
        low, high = prefix_range(code[q], np.asarray(group.column("level").combine_chunks())[q])
        lo, hi = np.searchsorted(code[e], low, side="left"), np.searchsorted(code[e], high, side="right")
        who, cand, score = [], [], []
        at = np.arange(len(e))
        for a in range(0, len(q), 256):
            rows = slice(a, a + 256)
            s = x[q[rows]] @ x[e].T
            s[(at < lo[rows, None]) | (at >= hi[rows, None])] = -np.inf
            take = min(best, s.shape[1])
            top = np.argpartition(-s, take - 1, axis=1)[:, :take] if take else np.zeros((len(s), 0), np.int64)
            val = np.take_along_axis(s, top, axis=1)
            for k in range(len(s)):
                ok = np.isfinite(val[k])
                who.append(ids[q[a + k]])
                cand.append(ids[e[top[k][ok]]].tobytes())
                score.append(val[k][ok].tobytes())
        return pa.table({"id": pa.array(who, pa.int64()), "cand": pa.array(cand, pa.binary()), "score": pa.array(score, pa.binary())})

    return run


def nearest(embeddings: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            trees: int = TREES, cell: int = CELL, budget: int = BUDGET) -> DataFrame:
    """query_id, rank, vec_id, score: for every id for which ``is_query(id column)`` holds, its ``k`` nearest others."""
    spark = embeddings.sparkSession
    prepare(spark)
    parts = partitions(spark)
    vectors = written(packed(embeddings, id_col, vec_col), "ann-vectors")
    groups = vectors.groupBy("key").agg(F.min("vec_id").alias("rep"), F.max(is_query(F.col("vec_id")).cast("int")).alias("asks"), F.count(F.lit(1)).alias("n"))
    entries = written(groups.join(vectors.select(F.col("vec_id").alias("rep"), "v"), "rep").select("rep", "v", "key", "asks", "n"), "ann-entries")
    shared = spark.sparkContext.broadcast(fit(entries, trees, cell, budget, k))

    def planted(query: bool, heavy: bool):
        names = ["dim", "tree", "cell", "salt", "kind", "id", "code"] + (["level", "v"] if heavy else [])

        def run(batches):
            forest = shared.value
            for b in batches:
                for rows, dim in _by_dim(b, 1):
                    for a in range(0, len(rows), 1024):
                        some = pa.array(rows[a:a + 1024])
                        x, ids = forest.scaled(dim, _vectors(b.column(1).take(some)), query), np.asarray(b.column(0).take(some))
                        raw = pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary()) if heavy else None
                        level = np.asarray(b.column(2).take(some)) if query and heavy else np.full(len(ids), BITS if query else 0, np.int32)
                        for t, all_rows, all_code, all_c, all_salt in forest.seek(dim, x, level) if query else forest.place(dim, x, ids):
                            for z in range(0, len(all_rows), 8192):  # a query may go to many cells
                                row, code, c, salt = (y[z:z + 8192] for y in (all_rows, all_code, all_c, all_salt))
                                n = len(row)
                                cols = [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(c), pa.array(salt), pa.array(np.full(n, int(query), np.int32)), pa.array(ids[row]), pa.array(K.signed(code))]
                                yield pa.RecordBatch.from_arrays(cols + ([pa.array(level[row]), raw.take(pa.array(row))] if heavy else []), names)

        return run

    light = "dim int, tree int, cell int, salt int, kind int, id long, code long"
    heavy = light + ", level int, v binary"
    cell_of = ["dim", "tree", "cell", "salt"]
    asks = entries.where("asks = 1").select("rep", "v")
    strings = entries.select("rep", "v").mapInArrow(planted(False, False), light).unionByName(asks.mapInArrow(planted(True, False), light))
    counts = strings.groupBy(*cell_of).applyInArrow(_descend(shared), "id long, dim int, counts binary").groupBy("id", "dim").agg(F.collect_list("counts").alias("counts"))

    def ascend(batches):
        for b in batches:
            level = []
            for dim, lists in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):  # one short list a tree and sub-cell
                total = np.sum([np.frombuffer(c, np.int64) for c in lists], axis=0)
                enough = np.flatnonzero(total >= shared.value.budget[dim])
                level.append(int(enough[-1]) if len(enough) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(level, pa.int32())], ["rep", "level"])

    levels = written(counts.mapInArrow(ascend, "rep long, level int"), "ann-levels")
    rows = entries.select("rep", "v").mapInArrow(planted(False, True), heavy).unionByName(asks.join(levels, "rep").select("rep", "v", "level").mapInArrow(planted(True, True), heavy))
    found = rows.groupBy(*cell_of).applyInArrow(_score(k + 1 + SPARE), "id long, cand binary, score binary").groupBy("id").agg(F.collect_list(F.struct("cand", "score")).alias("lists"))

    def merge(batches):
        for b in batches:
            who, cand = [], []
            for q, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.concatenate([np.frombuffer(x["cand"], np.int64) for x in lists])
                s = np.concatenate([np.frombuffer(x["score"], np.float32) for x in lists])
                c, at = np.unique(c, return_index=True)
                best = c[np.argsort(-s[at], kind="stable")[:k + 1 + SPARE]]
                who.append(np.full(len(best), q))
                cand.append(best)
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(np.concatenate(cand))], ["rep", "cand"])

    pairs = written(found.mapInArrow(merge, "rep long, cand long"), "ann-pairs")

    def exact(batches):
        for b in batches:
            if b.num_rows:
                with np.errstate(over="ignore", invalid="ignore"):
                    score = [float(np.dot(np.frombuffer(x, "<f8"), np.frombuffer(y, "<f8"))) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["rep", "cand", "score"])

    v = entries.select("rep", "v")
    scored = (pairs.join(v.toDF("rep", "vq"), "rep").join(v.toDF("cand", "vc"), "cand").select("rep", "cand", "vq", "vc").mapInArrow(exact, "rep long, cand long, score double"))
    # the k + 1 smallest ids of each vector stand for its copies (the rank limit works before the shuffle too)
    keys = entries.where("n > 1").select("key", "rep")
    copies = vectors.select("key", "vec_id").join(keys, "key").withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    members = entries.where("n = 1").select(F.col("rep").alias("cand"), F.col("rep").alias("vec_id")).unionByName(copies.select(F.col("rep").alias("cand"), "vec_id"))
    listed = (scored.join(members, "cand").groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k + 1).alias("near")))
    queries = vectors.where(is_query(F.col("vec_id"))).join(groups.select("key", "rep"), "key").select("rep", F.col("vec_id").alias("query_id"))
    out = queries.join(listed, "rep").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return (out.select("query_id", F.posexplode("near").alias("place", "hit"))
            .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score")))
