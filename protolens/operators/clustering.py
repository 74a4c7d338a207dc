"""Cluster prototypes per class (survey A9, A10).

k-means for every (layer, class) group at once: one distributed Lloyd step per
iteration (assign rows to the nearest centre of their own group, average per
cluster).  The rows are written once, with the columns that the steps need, and
once more as raw blocks of vectors: a step is one job over the blocks, with the
centres broadcast.  Centres past the broadcast limit are joined to the rows
instead, and written each iteration to cut lineage.  Initial centres are the
first k rows of each group in seeded hash order, or an oversampled start:
rounds that draw rows by their squared distance from the centres so far, whose
candidates are weighted by the rows nearest to them and thinned to k.  Only
centre tables (groups x some k x d) are ever attached to rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.functions import vec as V
from protolens.operators import blocks as B
from protolens.operators import stats as S
from protolens.operators.params import DEFAULT_MAX_BROADCAST_BYTES, attach_params, estimated_bytes, materialize, pack_params
from protolens.operators.sampling import sample_per_class

#: rows of a task at least, when vectors are dealt out as blocks
BLOCK_ROWS = 10_000

#: group -> (clusters, their centres as the rows of a matrix)
Centres = dict[tuple, tuple[list[int], np.ndarray]]


def _nearest(rows: DataFrame, centres: DataFrame, g: list[str], vec: str) -> DataFrame:
    """Rows with the number (``_near``) and squared distance (``_d2``) of the nearest centre of their group, the first on ties."""
    packed = pack_params(centres, g, "cluster", ["cluster", "center"], "_cs")
    d = F.transform("_cs", lambda t: V.sq_dist(vec, t["center"]))
    j = attach_params(rows, packed, g).withColumn("_d", d)
    best = F.element_at("_cs", F.array_position("_d", F.array_min("_d")).cast("int"))["cluster"]
    return j.withColumn("_near", best.cast("int")).withColumn("_d2", F.array_min("_d")).drop("_cs", "_d")


def _uniform(id_col: str, tag: str):
    """Number in [0, 1) from the md5 of a row's id and a tag, the same on every retry."""
    return F.conv(F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":" + tag))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def oversampled_start(rows: DataFrame, g: list[str], vec: str, k: int, id_col: str, seed: int = 42, rounds: int = 5) -> DataFrame:
    """(group, cluster 0..k-1, center): a start far apart, after ``rounds`` scans that each draw about 2 k rows a group."""
    first = sample_per_class(rows, 1, g[:-1], g[-1], id_col, seed, rank_col="_r")
    found = materialize(first.select(*g, F.lit(0).alias("cluster"), F.col(vec).alias("center")))
    for r in range(rounds):
        near = _nearest(rows, found, g, vec)
        cost = near.groupBy(*g).agg(F.sum("_d2").alias("_cost"), F.count("*").alias("_rows"))
        drawn = attach_params(near, cost, g).where(_uniform(id_col, f"{seed}:{r}") * F.col("_cost") < 2.0 * k * F.col("_d2"))
        taken = drawn.select(*g, id_col, F.col(vec).alias("center")).unionByName(found.select(*g, F.lit(None).cast(rows.schema[id_col].dataType).alias(id_col), "center"))
        number = F.row_number().over(Window.partitionBy(*g).orderBy(F.col(id_col).asc_nulls_first(), F.to_json(F.array("center"))))  # some k a group
        found = materialize(taken.select(*g, (number - 1).cast("int").alias("cluster"), "center"))
    weights = _nearest(rows, found, g, vec).groupBy(*g, F.col("_near").alias("cluster")).agg(F.count("*").alias("weight"))
    weighted = found.join(weights, [*g, "cluster"])
    schema = T.StructType([rows.schema[c] for c in g] + [T.StructField("cluster", T.IntegerType()), T.StructField("center", T.ArrayType(T.DoubleType()))])

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        """k of the candidates: the heaviest, then always the one with the largest weight times squared distance."""
        pdf = pdf.sort_values("cluster")
        x, w = np.stack(pdf["center"].to_numpy()).astype(np.float64), pdf["weight"].to_numpy()
        picked = [int(np.argmax(w))]
        d2 = ((x - x[picked[0]]) ** 2).sum(1)
        while len(picked) < min(k, len(x)):
            picked.append(int(np.argmax(w * d2)))
            d2 = np.minimum(d2, ((x - x[picked[-1]]) ** 2).sum(1))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in g), i, x[p].tolist()] for i, p in enumerate(picked)], columns=[f.name for f in schema.fields])

    return weighted.groupBy(*g).applyInPandas(thin, schema)


def _column_blocks(rows: DataFrame, g: list[str], vec: str) -> DataFrame:
    """(group, n, data): vectors of one group, the bytes of a matrix with a column for each; written."""
    schema = T.StructType([rows.schema[c] for c in g] + [T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())])
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    rows = rows.where(F.col(vec).isNotNull()).select(*g, vec)
    if rows.rdd.getNumPartitions() < parts:
        rows = rows.repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = list(zip(*(b.column(c).to_pylist() for c in g)))
            ends = [a for a in range(1, len(key) + 1) if a == len(key) or key[a] != key[a - 1]]
            for a, z in zip([0, *ends], ends):
                x = B._vectors(b.column(vec).slice(a, z - a))
                step = max(1, B.BLOCK_BYTES // (8 * max(1, x.shape[1])))
                for at in range(0, len(x), step):
                    part = x[at:at + step]
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(c).slice(a, 1) for c in g), pa.array([len(part)], pa.int32()),
                         pa.array([part.T.tobytes()], pa.binary())], schema.names)

    return B._written(rows.sortWithinPartitions(*g).mapInArrow(run, schema))


def _square_distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Of the columns of ``x``, added up in the order of ``V.sq_dist``."""
    d = np.zeros(x.shape[1])
    for row, c in zip(x, centre):
        d += (row - c) * (row - c)
    return d


def _first_smallest(d: np.ndarray) -> np.ndarray:
    """Row of the smallest number of each column, the first on ties; NaN is larger than any, as in Spark."""
    nan = np.isnan(d)
    best = np.where(nan, np.inf, d).argmin(0)
    if nan.any():
        wrong = nan[best, np.arange(d.shape[1])] & ~nan.all(0)
        best[wrong] = (~nan[:, wrong]).argmax(0)
    return best


def _cluster_sums(blocks: DataFrame, shared, g: list[str]) -> DataFrame:
    """(group, cluster, n, sum) of the rows nearest to each of the broadcast ``Centres``; a task sends one row a cluster."""
    schema = T.StructType([blocks.schema[c] for c in g] + [
        T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sum", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for b in batches:
            for *key, n, data in zip(*(b.column(c).to_pylist() for c in (*g, "n", "data"))):
                of = shared.value.get(tuple(key))
                if of is None:  # a group with a null key
                    continue
                x = np.frombuffer(data).reshape(-1, n)
                best = _first_smallest(np.stack([_square_distances(x, c) for c in of[1]]))
                for i in np.unique(best):
                    at = (*key, of[0][i])
                    count, total = found.get(at, (0, 0.0))
                    mine = best == i
                    found[at] = count + int(mine.sum()), total + x[:, mine].sum(1)
        if found:
            columns = [*zip(*found)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v, b.schema.field(c).type) for c, v in zip(g, columns)), pa.array(columns[-1], pa.int32()),
                 pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.list_(pa.float64()))], schema.names)

    return blocks.mapInArrow(run, schema).groupBy(*g, "cluster").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sum"))).alias("sum"))


def _lloyd_broadcast(slim: DataFrame, centres: DataFrame, g: list[str], vec: str, iters: int, tol: float) -> tuple[DataFrame, float]:
    """Centres after the last step and the largest squared move in it; one job a step."""
    spark, blocks, shift = slim.sparkSession, _column_blocks(slim, g, vec), 0.0

    def rows_of(table: pa.Table, values: str) -> Iterator[tuple]:  # a parameter table
        return zip(zip(*(table.column(c).to_pylist() for c in g)), table.column("cluster").to_pylist(), B._vectors(table.column(values)))

    held: Centres = {}
    for key, cluster, centre in rows_of(centres.orderBy(*g, "cluster").toArrow(), "center"):
        ids, matrix = held.get(key, ([], np.empty((0, len(centre)))))
        held[key] = [*ids, cluster], np.vstack([matrix, centre])
    for _ in range(iters):
        shared, moves = spark.sparkContext.broadcast(held), [0.0]
        table = _cluster_sums(blocks, shared, g).toArrow()
        held = {key: (ids, matrix.copy()) for key, (ids, matrix) in held.items()}
        if table.num_rows:
            for (key, cluster, total), n in zip(rows_of(table, "sum"), table.column("n").to_pylist()):
                ids, matrix = held[key]
                at, new = ids.index(cluster), total / n
                moves.append(float(_square_distances(new[:, None], matrix[at])[0]))
                matrix[at] = new
        shared.destroy()
        shift = float(np.max(moves))
        if shift <= tol:
            break
    rows = [(*key, i, c.tolist()) for key, (ids, matrix) in held.items() for i, c in zip(ids, matrix)]
    return materialize(spark.createDataFrame(rows, centres.schema)), shift


def _lloyd_joined(slim: DataFrame, centres: DataFrame, g: list[str], vec: str, iters: int, tol: float) -> tuple[DataFrame, float]:
    """As ``_lloyd_broadcast`` for centres of any size: joined to the rows, and written after each step."""
    shift = 0.0
    for _ in range(iters):
        a = _nearest(slim, centres, g, vec).withColumnRenamed("_near", "cluster")
        new = a.groupBy(*g, "cluster").agg(
            vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("new_center"))
        merged = centres.join(new, g + ["cluster"], "left").select(
            *g, "cluster", F.coalesce("new_center", "center").alias("center"),
            V.sq_dist(F.coalesce("new_center", "center"), "center").alias("_shift"))
        merged = materialize(merged)  # cuts the lineage of the iteration
        shift = merged.agg(F.max("_shift")).first()[0] or 0.0
        centres = merged.drop("_shift")
        if shift <= tol:
            break
    return centres, shift


def grouped_kmeans(df: DataFrame, keys=("layer",), label: str = "label", vec: str = "vector", k: int = 2,
                   iters: int = 300, seed: int = 42, id_col: str = "example_id", tol: float = 1e-9, start: str = "first"):
    """Returns (centres(keys..., label, cluster, center), assignments(df + cluster)).

    ``start``: 'first' (first k rows in hash order) or 'oversampled'.  Runs until no centre moves; a warning tells when
    ``iters`` rounds were not enough.
    """
    keys = list(keys)
    g = keys + [label]
    slim = materialize(df.select(*g, id_col, vec))
    if start == "oversampled":
        centres = oversampled_start(slim, g, vec, k, id_col, seed)
    else:
        init = sample_per_class(slim, k, keys, label, id_col, seed, rank_col="_r")
        centres = init.select(*g, (F.col("_r") - 1).cast("int").alias("cluster"), F.col(vec).alias("center"))
    centres = materialize(centres)

    limit = int(df.sparkSession.conf.get("protolens.maxBroadcastBytes", str(DEFAULT_MAX_BROADCAST_BYTES)))
    lloyd = _lloyd_broadcast if estimated_bytes(centres) <= limit else _lloyd_joined
    centres, shift = lloyd(slim, centres, g, vec, iters, tol)
    if iters and not shift <= tol:
        warnings.warn(f"k-means: centres still moved by {shift:g} after {iters} rounds", RuntimeWarning, stacklevel=2)
    return centres, _nearest(df, centres, g, vec).withColumnRenamed("_near", "cluster").drop("_d2")


def cluster_prototypes(df: DataFrame, keys=("layer",), label: str = "label", vec: str = "vector",
                       n_clusters_per_class: int = 2, iters: int = 300, seed: int = 42, id_col: str = "example_id",
                       scale_covariances: bool = False, start: str = "first"):
    """Cluster ids offset by class (class * k + c); per-cluster and pooled covariance keyed by example."""
    keys = list(keys)
    centres, assigned = grouped_kmeans(df, keys, label, vec, n_clusters_per_class, iters, seed, id_col, start=start)
    assigned = assigned.withColumn("cluster_id", (F.col(label) * n_clusters_per_class + F.col("cluster")).cast("int"))
    means = S.class_means(assigned, keys, "cluster_id", vec)
    scatter = S.class_scatter(assigned, keys, "cluster_id", vec, means)
    cluster_cov = S.class_covariance(scatter, keys, "cluster_id")
    if scale_covariances:
        cluster_cov = S.diag_norm_scaling(cluster_cov, keys + ["cluster_id"])
    return {
        "centres": centres.withColumn("cluster_id", (F.col(label) * n_clusters_per_class + F.col("cluster")).cast("int")),
        "assigned": assigned,
        "means": means,
        "cluster_cov": cluster_cov,
        "pooled": S.pooled_covariance(scatter, keys),
    }


def cluster_precisions(protos: dict, keys=("layer",)) -> dict:
    """A10: Bayes precision of the pooled and of every cluster covariance."""
    keys = list(keys)
    return {
        "precision": S.bayes_precision(protos["pooled"], keys),
        "cluster_precision": S.bayes_precision(protos["cluster_cov"], keys + ["cluster_id"]),
    }
