"""Grids of nested experiments: a prototype model for every (seed, sample size) from one pass of statistics (SP7, G19).

A training row gets, for each seed, the index of the smallest sample size that reaches its rank in that seed's order.
Means and Gram matrices are summed by (keys, class, seed, size index) and cumulated over the size index, since a sample of
one size contains the smaller ones: the matrices of all cells come from one scan, and no row is copied for a cell.
Vectors are centred by the mean of their whole class before the products, which avoids cancellation.

Test rows meet the models of all cells of their key at once (``blocks.score``), so each vector is scored in one place.
A size beyond a class takes all of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.functions import vec as V
from protolens.operators import blocks as B
from protolens.operators import stats as S
from protolens.operators.params import attach_params, materialize
from protolens.operators.sampling import hash_order, rank_cut


def _seeded(ids: DataFrame, seeds: Sequence[int], id_col: str) -> DataFrame:
    rows = ids.withColumn("_seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    return rows.withColumn("_h", hash_order(id_col, F.col("_seed")))


def _by_seed(ranked: DataFrame, seeds: Sequence[int], id_col: str, cell: Column) -> DataFrame:
    return ranked.groupBy(id_col).agg(F.array(*[F.max(F.when(F.col("_seed") == int(s), cell)) for s in seeds]).alias("cells"))


def cells_by_size(ids: DataFrame, seeds: Sequence[int], sizes: Sequence[int], label: str = "label", id_col: str = "example_id") -> DataFrame:
    """(id, cells): for each seed the index in ``sizes`` (ascending) of the smallest sample per class that holds the row,
    null where none does."""
    ranked = rank_cut(_seeded(ids.select(id_col, label), seeds, id_col), ["_seed", label], "_h", id_col, max(sizes))
    first = F.size(F.filter(F.array(*[F.lit(int(z)) for z in sizes]), lambda z: z < F.col("rank")))
    return _by_seed(ranked, seeds, id_col, first)


def cells_by_fraction(ids: DataFrame, seeds: Sequence[int], frac: float, id_col: str = "example_id") -> DataFrame:
    """(id, cells): 0 for each seed whose round(frac * n) first rows hold the row, null elsewhere."""
    k = int(round(frac * ids.count()))
    return _by_seed(rank_cut(_seeded(ids.select(id_col), seeds, id_col), ["_seed"], "_h", id_col, k), seeds, id_col, F.lit(0))


def _cell_grams(rows: DataFrame, group: list[str], vec: str, n_seeds: int, only: int | None) -> DataFrame:
    """Partial sums (group, seed, size, i, n, s, g) of each input partition; ``only``: of one seed, group after group."""
    schema = T.StructType([rows.schema[c] for c in group] + [T.StructField(c, T.IntegerType()) for c in ("_seed", "_size", "i")] + [
        T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("g", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema.fields]

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for (key, seed, size), (n, s, g) in held.items():
            d = len(s)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(d + 1) * d, pa.int32()), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v] * d, t) for v, t in zip(key, types)), pa.array([seed] * d, pa.int32()), pa.array([size] * d, pa.int32()),
                 pa.array(np.arange(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s), lists], names)

    types: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            if not types:
                types.extend(b.schema.field(c).type for c in group)
            if not b.num_rows:
                continue
            x_all, keys = B._vectors(b.column(vec)), list(zip(*(b.column(c).to_pylist() for c in group)))
            cells = np.asarray(b.column("cells").flatten().fill_null(-1)).reshape(len(keys), -1)
            of: dict = {}
            for at, key in enumerate(keys):
                of.setdefault(key, []).append(at)
            for key, at in of.items():
                x, c = x_all[at], cells[at]
                for seed in range(n_seeds) if only is None else (only,):
                    for size in np.unique(c[:, seed]):
                        if size < 0:
                            continue
                        part = x[c[:, seed] == size]
                        cell = (key, seed, int(size))
                        if only is not None and held and cell not in held:
                            yield from emit(held)
                            held = {}
                        old = held.get(cell)
                        if old is None:
                            held[cell] = [len(part), part.sum(axis=0), part.T @ part]
                        else:
                            old[0] += len(part)
                            old[1] += part.sum(axis=0)
                            old[2] += part.T @ part
        yield from emit(held)

    return rows.mapInArrow(run, schema)


def fit_cells(train: DataFrame, cells: DataFrame, n_seeds: int, n_sizes: int, keys=("layer",), label: str = "label",
              vec: str = "vector", id_col: str = "example_id") -> dict[str, DataFrame]:
    """means (keys, _seed, _size, label, n, mean), precision (keys, _seed, _size, i, n, row) and GDA params of every cell;
    ``_seed`` and ``_size`` are positions in the lists that ``cells`` was made from."""
    keys = list(keys)
    group, cell = keys + [label], keys + ["_seed", "_size"]
    shift = materialize(S.class_means(train, keys, label, vec))
    # one row an example: unique keys, as good as uniform
    rows = attach_params(train.select(*group, id_col, vec), cells, [id_col], uniform_keys=True)
    rows = attach_params(rows, shift.select(*group, F.col("mean").alias("_shift")), group, materialized=True)
    rows = rows.select(*group, "cells", V.sub(vec, "_shift").alias(vec))
    info = shift.agg(F.count("*").alias("k"), F.max(F.size("mean")).alias("d")).first()
    state = (info.k or 0) * n_seeds * n_sizes * (info.d or 0) ** 2 * 8
    if state <= S.GRAM_STATE_BUDGET_BYTES:
        partial = _cell_grams(rows, group, vec, n_seeds, None)
    else:  # a scan a seed, sorted by cell: one matrix at a time
        parts = [_cell_grams(rows.sortWithinPartitions(*group, F.col("cells")[k]), group, vec, n_seeds, k) for k in range(n_seeds)]
        partial = parts[0]
        for p in parts[1:]:
            partial = partial.unionByName(p)
    merged = S.merge_gram(partial, group + ["_seed", "_size"])
    # sums over the size index, row by row of the matrices: at most n_sizes entries a group
    gathered = merged.groupBy(*group, "_seed", "i").agg(F.collect_list(F.struct("_size", "n", "s", "g")).alias("t"))
    cumulated = gathered.select(*group, "_seed", "i", "t", F.explode(F.sequence(F.lit(0), F.lit(n_sizes - 1))).alias("_size"))
    cumulated = cumulated.withColumn("t", F.filter("t", lambda x: x["_size"] <= F.col("_size"))).where(F.size("t") > 0)
    zero = F.transform(F.col("t")[0]["g"], lambda x: F.lit(0.0))
    cumulated = materialize(cumulated.select(
        *group, "_seed", "_size", "i", F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"),
        F.aggregate("t", F.lit(0.0), lambda a, x: a + x["s"]).alias("s"),
        F.aggregate("t", zero, lambda a, x: V.add(a, x["g"])).alias("g")))
    offsets = cumulated.groupBy(*group, "_seed", "_size").agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("o")))), lambda x: x["o"]).alias("_o"))
    means = attach_params(offsets, shift.select(*group, F.col("mean").alias("_shift")), group, materialized=True)
    means = materialize(means.select(*group, "_seed", "_size", "n", V.add("_o", "_shift").alias("mean")))
    pooled = S.pooled_covariance(S._rows_to_scatter(cumulated, group + ["_seed", "_size"]), cell)
    precision = materialize(S.bayes_precision(pooled, cell))
    return {"means": means, "precision": precision, "params": materialize(S.gda_params(means, precision, cell, label))}


def score_cells(rows: DataFrame, fit: dict[str, DataFrame], n_sizes: int, keys=("layer",), label: str = "label",
                vec: str = "vector", keep: Sequence[str] = ("example_id",)) -> DataFrame:
    """(keys, keep, _seed, _size, method, score): probability of class 1 by GDA, nearest mean and Mahalanobis distance in
    every cell.  A vector meets the models of all cells of its key in one pass a method."""
    keys, keep = list(keys), list(keep)
    k = (fit["means"].agg(F.max(label)).first()[0] or 0) + 1
    place = F.col("_seed") * n_sizes + F.col("_size")
    named = lambda t: t.withColumn("_cls", place * k + F.col(label))
    means = B.vector_blocks(named(fit["means"]), keys, "_cls", F.col("mean"))
    weights = B.vector_blocks(named(fit["params"]), keys, "_cls", F.concat("w", F.array("b")))
    factors = B.factor_blocks(fit["precision"].withColumn("_cell", place), keys, "_cell")
    ways = [("gda", weights, B.logits, 1.0), ("nmc", means, B.negative_distance, 1.0),
            ("mahalanobis", means.unionByName(factors), B.mahalanobis_of(k), -1.0)]
    out = None
    for method, blocks, fold, sign in ways:
        s = B.score(rows, blocks, keys, vec, "_s", fold, keep=[*keys, *keep])
        # cells are dense: every seed and size has every class
        s = s.select(*keys, *keep, F.posexplode(F.transform(
            F.sequence(F.lit(0), (F.size("_s") / k).cast("int") - 1),
            lambda c: F.element_at(V.softmax(F.transform(F.slice("_s", c * k + 1, k), lambda x: x * sign)), 2))).alias("_at", "score"))
        s = s.select(*keys, *keep, F.floor(F.col("_at") / n_sizes).cast("int").alias("_seed"), (F.col("_at") % n_sizes).alias("_size"),
                     F.lit(method).alias("method"), "score")
        out = s if out is None else out.unionByName(s)
    return out
