"""Random forests whose trees stay in tables (survey G17), for as many rows as there are.

The forest is that of ``RandomForestClassifier``: rows drawn with replacement
(Poisson weights), sqrt(d) features a node, thresholds at quantiles, Gini gain,
depth up to 30, leaves of one prediction merged, votes of class shares.  Its
draws are hashes of the tree and the node instead of one sequence for the
whole forest, so trees grow apart from each other.

Vectors are kept as blocks of bin numbers.  A node whose rows a task can hold
is grown to its leaves by that task, and its ``piece`` of the tree is written;
nodes above are split level by level from histograms that the tasks add up.
The driver holds only those top nodes, some rows / (rows of a task) a tree.
Rows are scored where their pieces are: a piece gets the rows that reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.operators.params import materialize

#: thresholds split a feature's values into so many bins at most, as MLlib's maxBins
BINS = 32
MAX_DEPTH = 30
#: bytes of bin numbers that a task holds to grow a node to its leaves
DEFAULT_TASK_BYTES = 32 * 1024 * 1024
#: numbers of a histogram, or bytes of a batch, that a task makes at once
AT_ONCE = 1 << 20

BLOCKS = "part int, seq int, n int, x binary, y binary"
PIECES = "tree int, pos int, nodes int, feature binary, bin binary, child binary, counts binary"


class Nodes(NamedTuple):
    """A tree or a part of one, its root first.  feature: -1 at leaves; child: position of the left child (the right one follows),
    number of the leaf at leaves; counts: rows of each class, by leaf."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    counts: np.ndarray


class Top(NamedTuple):
    """The nodes of a tree above its pieces.  child: as in ``Nodes``, -1 at leaves; ids: 1 at the root, 2 i and 2 i + 1 below i;
    counts: rows of each class; open: whether a piece is to be grown below a leaf."""

    feature: list[int]
    bin: list[int]
    child: list[int]
    ids: list[int]
    counts: list[np.ndarray]
    open: list[bool]


class Forest(NamedTuple):
    """thresholds: of each feature, ascending; pieces: the table of ``PIECES``, one for each leaf of each top."""

    thresholds: list[np.ndarray]
    tops: list[Top]
    pieces: DataFrame
    classes: int


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feature_subsets(ids: np.ndarray, tree: int, seed: int, d: int, m: int) -> np.ndarray:
    """``m`` of ``d`` features for each node of a tree, drawn without replacement; in order if it is all of them."""
    if m == d:
        return np.tile(np.arange(d), (len(ids), 1))
    node = _mixed(np.asarray(ids).astype(np.uint64) ^ _mixed(np.array([tree], np.uint64) ^ _mixed(np.array([seed], np.int64).view(np.uint64))))
    keys = _mixed(node[:, None] ^ _mixed(np.arange(d, dtype=np.uint64))[None, :])
    found = np.argpartition(keys, m - 1, axis=1)[:, :m]
    return np.take_along_axis(found, np.argsort(np.take_along_axis(keys, found, 1), axis=1), 1)


def _gini(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    out = np.ones(total.shape)
    for k in range(counts.shape[-1]):
        share = counts[..., k] / total
        out -= share * share
    return out


def best_splits(hist: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of histograms (node, feature of its subset, bin, class): gain, place of the feature and bin of the best split, the first on ties."""
    with np.errstate(divide="ignore", invalid="ignore"):
        upto = hist.cumsum(2)
        left, total = upto[:, :, :-1], upto[:, :, -1:]
        right = total - left
        nl, nr, n = left.sum(-1), right.sum(-1), total.sum(-1)
        gain = _gini(total, n) - nl / n * _gini(left, nl) - nr / n * _gini(right, nr)
    gain[(nl == 0) | (nr == 0)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    return flat[np.arange(len(flat)), best], best // (hist.shape[2] - 1), best % (hist.shape[2] - 1)


def _histograms(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, subsets: np.ndarray, classes: int) -> np.ndarray:
    """(node, feature of its subset, bin, class) from rows at the nodes ``at``."""
    nodes, m = subsets.shape
    own = x[np.arange(len(x))[:, None], subsets[at]].astype(np.int64)
    cell = ((at[:, None] * m + np.arange(m)) * BINS + own) * classes + y[:, None]
    return np.bincount(cell.ravel(), np.repeat(w, m), nodes * m * BINS * classes).reshape(nodes, m, BINS, classes)


def subset_size(d: int) -> int:
    return math.ceil(math.sqrt(d))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, tree: int, root: int, seed: int, m: int) -> Nodes:
    """Grow the node ``root`` of a tree to its leaves, level by level.  x: bin numbers (rows, features), w: how often a row was drawn."""
    y, w, d = y.astype(np.int64), w.astype(np.float64), x.shape[1]
    step = max(1, AT_ONCE // max(d, m * BINS * classes))
    counts = np.bincount(y, w, classes)[None, :]
    levels, made = [], 1  # per level: feature, bin, left child, counts
    ids, rows, at = np.array([root], np.int64), np.arange(len(x)), np.zeros(len(x), np.int64)
    depth = root.bit_length() - 1
    while True:
        feature, bins, child = np.full(len(ids), -1, np.int32), np.zeros(len(ids), np.uint8), np.full(len(ids), -1, np.int32)
        levels.append((feature, bins, child, counts))
        tried = np.flatnonzero((counts > 0).sum(1) > 1) if depth < MAX_DEPTH else np.empty(0, np.int64)
        if not len(tried):
            break
        rank = np.full(len(ids), -1)
        rank[tried] = np.arange(len(tried))
        keep = rank[at] >= 0
        rows, at = rows[keep], rank[at[keep]]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        for a in range(0, len(tried), step):
            z = min(a + step, len(tried))
            lo, hi = np.searchsorted(at, [a, z])
            subsets, part = feature_subsets(ids[tried[a:z]], tree, seed, d, m), rows[lo:hi]
            gain, place, cut = best_splits(_histograms(x[part], y[part], w[part], at[lo:hi] - a, subsets, classes))
            split = np.flatnonzero(gain > 0)
            feature[tried[a:z][split]] = subsets[split, place[split]]
            bins[tried[a:z][split]] = cut[split]
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        child[split] = made + 2 * np.arange(len(split))
        made += 2 * len(split)
        node = tried[at]
        keep = feature[node] >= 0
        rows, node = rows[keep], node[keep]
        rank = np.full(len(ids), -1)
        rank[split] = np.arange(len(split))
        at = 2 * rank[node] + (x[rows, feature[node]] > bins[node])
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], 1).ravel()
        counts = np.bincount(at * classes + y[rows], w[rows], len(ids) * classes).reshape(-1, classes)
        depth += 1
    return _pruned(levels)


def _pruned(levels: list[tuple]) -> Nodes:
    """Leaves of one parent that predict the same class become one, from the bottom up; what is cut off is left out."""
    feature, bins, child = (np.concatenate([v[i] for v in levels]) for i in range(3))
    counts = np.concatenate([v[3] for v in levels]).astype(np.int64)
    says, ends = counts.argmax(1), np.cumsum([len(v[0]) for v in levels])
    for a, z in reversed(list(zip([0, *ends], ends))):
        p = a + np.flatnonzero(feature[a:z] >= 0)
        c = child[p]
        feature[p[(feature[c] < 0) & (feature[c + 1] < 0) & (says[c] == says[c + 1])]] = -1
    keep = np.zeros(len(feature), bool)
    keep[0] = True
    for a, z in zip([0, *ends], ends):
        p = a + np.flatnonzero(keep[a:z] & (feature[a:z] >= 0))
        keep[child[p]] = keep[child[p] + 1] = True
    new = np.cumsum(keep) - 1
    feature, bins, child, counts = feature[keep], bins[keep], child[keep], counts[keep]
    leaf = feature < 0
    child = np.where(leaf, np.cumsum(leaf) - 1, new[child]).astype(np.int32)
    return Nodes(feature, bins, child, counts[leaf])


def route(x: np.ndarray, feature: np.ndarray, bins: np.ndarray, child: np.ndarray) -> np.ndarray:
    """Position of the leaf that each row of bin numbers reaches."""
    pos, going = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        going = going[feature[pos[going]] >= 0]
        if not len(going):
            return pos
        p = pos[going]
        pos[going] = child[p] + (x[going, feature[p]] > bins[p])


def _top_routes(tops: list[Top]) -> list[tuple[np.ndarray, ...]]:
    return [(np.array(t.feature), np.array(t.bin), np.array(t.child)) for t in tops]


def _vectors(col: pa.Array, d: int) -> np.ndarray:
    if col.null_count or len(values := col.flatten()) != d * len(col) or values.null_count:
        raise ValueError(f"a forest needs vectors of {d} numbers without nulls")
    return values.to_numpy(zero_copy_only=False).reshape(-1, d)


def binned(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: how many of the feature's thresholds are below a value."""
    return np.stack([np.searchsorted(t, x[:, i]) for i, t in enumerate(thresholds)], 1).astype(np.uint8)


def find_thresholds(data: DataFrame, vec: str) -> list[np.ndarray]:
    """Of every feature, from all rows: midpoints of its values if they are few, else quantiles."""
    x = data.select(F.posexplode(vec).alias("i", "x"))
    found = x.groupBy("i").agg(F.percentile_approx("x", [k / BINS for k in range(1, BINS)], 10_000).alias("q"), F.approx_count_distinct("x").alias("n")).collect()
    few = [r.i for r in found if r.n <= 2 * BINS]
    values = {r.i: np.unique(r.v) for r in x.where(F.col("i").isin(few)).groupBy("i").agg(F.collect_set("x").alias("v")).collect()} if few else {}
    out = {}
    for r in found:
        v = values.get(r.i)
        out[r.i] = v[:-1] / 2 + v[1:] / 2 if v is not None and len(v) <= BINS else np.unique(r.q)
    return [out[i] for i in range(len(out))]


def _sent(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size > 8 * AT_ONCE:
            yield _sent(held, schema)
            held, size = [], 0
    if held:
        yield _sent(held, schema)


def _arrow(df_schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in df_schema.split(", "))])


def _blocks(data: DataFrame, vec: str, label: str, thresholds: list[np.ndarray]) -> DataFrame:
    """The rows as blocks of bin numbers, written, so that a block's number and with it its draws stay."""
    schema = _arrow(BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, b in enumerate(batches):
            if b.num_rows:
                x = binned(_vectors(b.column(vec), len(thresholds)), thresholds)
                y = b.column(label).to_numpy(zero_copy_only=False).astype(np.uint8)
                yield _sent([(part, seq, b.num_rows, x.tobytes(), y.tobytes())], schema)

    return materialize(data.select(vec, label).mapInArrow(run, BLOCKS))


def _rows_of(batches: Iterator[pa.RecordBatch], d: int, trees: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """x, y of each block, and how often each tree drew its rows."""
    for b in batches:
        for part, seq, n, x, y in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "n", "x", "y"))):
            drawn = np.random.default_rng([seed & 0xFFFFFFFF, part, seq]).poisson(1.0, (trees, n)).astype(np.uint8)
            yield np.frombuffer(x, np.uint8).reshape(n, d), np.frombuffer(y, np.uint8), drawn


def _split_tops(blocks: DataFrame, tops: list[Top], big: dict[int, list[int]], classes: int, d: int, m: int, seed: int) -> list:
    """(tree, pos, gain, feature, bin, left, right) of the top leaves in ``big``; one job, a task sends a histogram a node and some batches of rows."""
    schema, out = _arrow("tree int, pos int, hist binary"), "tree int, pos int, gain double, feature int, bin int, left array<long>, right array<long>"
    routes, ids, trees = _top_routes(tops), {t: np.array([tops[t].ids[p] for p in ps]) for t, ps in big.items()}, len(tops)

    def sent(sums: dict) -> Iterator[pa.RecordBatch]:
        return _batched(((t, p, h.tobytes()) for (t, p), h in sums.items()), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for x, y, drawn in _rows_of(batches, d, trees, seed):
            for t, ps in big.items():
                own = np.flatnonzero(drawn[t])
                pos = route(x[own], *routes[t])
                for k, p in enumerate(ps):
                    r = own[pos == p]
                    subset = feature_subsets(ids[t][k:k + 1], t, seed, d, m)
                    h = _histograms(x[r], y[r].astype(np.int64), drawn[t, r].astype(np.float64), np.zeros(len(r), np.int64), subset, classes)
                    sums[t, p] = sums.get((t, p), 0) + h.astype(np.int64)
            if sum(h.nbytes for h in sums.values()) > 64 * AT_ONCE:
                yield from sent(sums)
                sums = {}
        yield from sent(sums)

    def best(table: pa.Table) -> pa.Table:
        t, p = table["tree"][0].as_py(), table["pos"][0].as_py()
        hist = sum(np.frombuffer(h, np.int64) for h in table["hist"].to_pylist()).reshape(1, m, BINS, classes)
        gain, place, cut = (v[0] for v in best_splits(hist))
        left = hist[0, place, :cut + 1].sum(0)
        right = hist[0, place].sum(0) - left
        feature = feature_subsets(ids[t][[big[t].index(p)]], t, seed, d, m)[0, place]
        return pa.table([pa.array([t], pa.int32()), pa.array([p], pa.int32()), pa.array([float(gain)]), pa.array([int(feature)], pa.int32()),
                         pa.array([int(cut)], pa.int32()), pa.array([left.tolist()], pa.list_(pa.int64())), pa.array([right.tolist()], pa.list_(pa.int64()))],
                        ["tree", "pos", "gain", "feature", "bin", "left", "right"])

    return blocks.mapInArrow(run, "tree int, pos int, hist binary").groupBy("tree", "pos").applyInArrow(best, out).collect()


def _grow_tops(blocks: DataFrame, rows: int, most: int, trees: int, classes: int, d: int, m: int, seed: int) -> list[Top]:
    """Split nodes of more than ``most`` rows, one job a level; the rest are left to the pieces."""
    tops = [Top([-1], [0], [-1], [1], [np.zeros(classes, np.int64)], [True]) for _ in range(trees)]
    big = {t: [0] for t in range(trees)} if rows > most else {}
    while big:
        for r in _split_tops(blocks, tops, big, classes, d, m, seed):
            top, pos = tops[r.tree], r.pos
            top.counts[pos], top.open[pos] = np.array(r.left) + np.array(r.right), False
            if r.gain > 0:
                top.feature[pos], top.bin[pos], top.child[pos] = r.feature, r.bin, len(top.feature)
                for k, c in enumerate((r.left, r.right)):
                    at = 2 * top.ids[pos] + k
                    for column, v in zip(top, (-1, 0, -1, at, np.array(c), sum(x > 0 for x in c) > 1 and at.bit_length() - 1 < MAX_DEPTH)):
                        column.append(v)
        big = {t: ps for t, top in enumerate(tops) if (ps := [p for p, o in enumerate(top.open) if o and top.counts[p].sum() > most])}
    return tops


def _piece(tree: int, pos: int, n: Nodes) -> tuple:
    return tree, pos, len(n.feature), n.feature.astype(np.int32).tobytes(), n.bin.astype(np.uint8).tobytes(), n.child.astype(np.int32).tobytes(), n.counts.astype(np.int64).tobytes()


def _grow_pieces(blocks: DataFrame, tops: list[Top], classes: int, d: int, m: int, seed: int) -> DataFrame:
    """The pieces below the open leaves of the tops, written; each is grown by one task from the rows that reach it."""
    schema, sent = _arrow(PIECES), "tree int, pos int, x binary, y binary, w binary"
    routes, trees, is_open, ids = _top_routes(tops), len(tops), [t.open for t in tops], [t.ids for t in tops]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for x, y, drawn in _rows_of(batches, d, trees, seed):
                for t in range(trees):
                    own = np.flatnonzero(drawn[t])
                    pos = route(x[own], *routes[t])
                    for p in np.unique(pos):
                        if is_open[t][p]:
                            r = own[pos == p]
                            yield t, int(p), x[r].tobytes(), y[r].tobytes(), drawn[t, r].tobytes()

        yield from _batched(rows(), _arrow(sent))

    def fit(table: pa.Table) -> pa.Table:
        t, p = table["tree"][0].as_py(), table["pos"][0].as_py()
        x, y, w = (np.concatenate([np.frombuffer(v, np.uint8) for v in table[c].to_pylist()]) for c in ("x", "y", "w"))
        nodes = grow(x.reshape(-1, d), y, w, classes, t, ids[t][p], seed, m)
        return pa.Table.from_batches([_sent([_piece(t, p, nodes)], schema)])

    dealt = blocks.mapInArrow(deal, sent).repartition(_parts(blocks, tops), "tree", "pos")
    return materialize(dealt.groupBy("tree", "pos").applyInArrow(fit, PIECES))


def _parts(df: DataFrame, tops: list[Top]) -> int:
    """One a piece, as far as there are tasks to fill: what pieces take is time, not bytes."""
    spark = df.sparkSession
    return min(sum(sum(f < 0 for f in t.feature) for t in tops), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _prune_tops(tops: list[Top], pieces: DataFrame, classes: int) -> None:
    """Merge leaves of one prediction across pieces: those of a single leaf, and closed top leaves."""
    single = {(t, p): c for t, p, c in pieces.where("nodes = 1").select("tree", "pos", "counts").collect()}
    for t, top in enumerate(tops):
        for p in reversed(range(len(top.feature))):
            if top.feature[p] < 0 and (t, p) in single:
                top.counts[p], top.open[p] = np.frombuffer(single[t, p], np.int64).reshape(-1, classes)[0], False
            elif top.feature[p] >= 0:
                a, z = top.child[p], top.child[p] + 1
                if all(top.feature[c] < 0 and not top.open[c] for c in (a, z)) and top.counts[a].argmax() == top.counts[z].argmax():
                    top.feature[p], top.child[p] = -1, -1


def fit(data: DataFrame, vec: str, label: str, trees: int, seed: int) -> Forest:
    """A forest of the rows of ``data``; ``label``: class numbers from 0."""
    spark = data.sparkSession
    data = data.select(vec, F.col(label).cast("double").alias(label))
    odd = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    wrong = F.col(label).isNull() | (F.col(label) < 0) | (F.col(label) != F.floor(label)) | F.col(vec).isNull() | odd
    had = data.agg(F.count("*").alias("rows"), F.max(label).alias("last"), F.min(F.size(vec)).alias("d"), F.max(F.size(vec)).alias("most"), F.count_if(wrong).alias("wrong")).first()
    if had.wrong or had.d != had.most or had.last < 1 or had.last > 99:
        raise ValueError("a forest needs classes 0, 1 ... (100 at most) and vectors of one length without nulls, NaN and infinities")
    classes, d, m = int(had["last"]) + 1, had.d, subset_size(had.d)
    thresholds = find_thresholds(data, vec)
    blocks = _blocks(data, vec, label, thresholds)
    most = max(1, int(spark.conf.get("protolens.forestTaskBytes", str(DEFAULT_TASK_BYTES))) // (d + 2))
    tops = _grow_tops(blocks, had.rows, most, trees, classes, d, m, seed)
    pieces = _grow_pieces(blocks, tops, classes, d, m, seed)
    if any(len(t.feature) > 1 for t in tops):
        _prune_tops(tops, pieces, classes)
        closed = [_piece(t, p, Nodes(np.array([-1]), np.array([0]), np.array([0]), top.counts[p][None, :]))
                  for t, top in enumerate(tops) for p, f in enumerate(top.feature) if f < 0 and not top.open[p]]
        if closed:  # parameter-sized: leaves of the tops
            pieces = pieces.where("nodes > 1").unionByName(spark.createDataFrame([tuple(map(lambda v: bytearray(v) if isinstance(v, bytes) else v, c)) for c in closed], PIECES))
    return Forest(thresholds, tops, pieces, classes)


def predict(forest: Forest, df: DataFrame, vec: str, out: str) -> DataFrame:
    """``df`` with the share of class 1 among the votes of the trees; pieces get the rows that reach them, votes go back to the rows."""
    thresholds, tops, classes = forest.thresholds, forest.tops, forest.classes
    d, routes, parts = len(thresholds), _top_routes(tops), _parts(df, tops)
    rows = materialize(df.drop(out).withColumn("_row", F.monotonically_increasing_id()))
    asked, voted, scores = "block long, tree int, pos int, ids binary, x binary", "block long, tree int, ids binary, votes binary", "_row long, _score double"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            part = TaskContext.get().partitionId()
            for seq, b in enumerate(batches):
                x, ids = binned(_vectors(b.column(vec), d), thresholds), b.column("_row").to_numpy()
                for t, own in enumerate(routes):
                    pos = route(x, *own)
                    for p in np.unique(pos):
                        r = pos == p
                        yield (part << 32) + seq, t, int(p), ids[r].tobytes(), x[r].tobytes()

        yield from _batched(found(), _arrow(asked))

    def vote(left: pa.Table, right: pa.Table) -> pa.Table:
        sent = []
        if left.num_rows and right.num_rows:  # a tree that drew no row has no piece and no vote
            feature, bins, child, counts = (np.frombuffer(right[c][0].as_py(), k) for c, k in zip(("feature", "bin", "child", "counts"), (np.int32, np.uint8, np.int32, np.int64)))
            counts = counts.reshape(-1, classes)
            share = counts[:, 1] / counts.sum(1)
            for block, t, ids, x in zip(*(left[c].to_pylist() for c in ("block", "tree", "ids", "x"))):
                pos = route(np.frombuffer(x, np.uint8).reshape(-1, d), feature, bins, child)
                sent.append((block, t, ids, share[child[pos]].tobytes()))
        schema = _arrow(voted)
        return pa.Table.from_batches([_sent(sent, schema)] if sent else [], schema)

    def add(table: pa.Table) -> pa.Table:
        votes = sorted(zip(table["tree"].to_pylist(), (np.frombuffer(v, np.int64) for v in table["ids"].to_pylist()), (np.frombuffer(v) for v in table["votes"].to_pylist())), key=lambda v: v[0])
        ids = np.unique(np.concatenate([v[1] for v in votes]))
        total, n = np.zeros(len(ids)), np.zeros(len(ids))
        for _, own, share in votes:
            at = np.searchsorted(ids, own)
            total[at] += share
            n[at] += 1
        return pa.table([ids, total / n], _arrow(scores))

    wanted = rows.select("_row", vec).mapInArrow(ask, asked).repartition(parts, "tree", "pos").groupBy("tree", "pos")
    votes = wanted.cogroup(forest.pieces.repartition(parts, "tree", "pos").groupBy("tree", "pos")).applyInArrow(vote, voted)
    return rows.join(votes.groupBy("block").applyInArrow(add, scores), "_row", "left").withColumnRenamed("_score", out).drop("_row")
