"""Per-class isolation-forest outlier filter (survey F9).

* Tree samples: every row draws a uniform hash per tree; a row joins tree t
  when its hash is below a per-class acceptance rate (a hash prefilter), and
  the exact ``max_samples`` rows per (group, tree) are then taken with the
  bucketed rank cut.  No row is replicated to all trees.
* Fitting: one ``applyInPandas`` group per (group, tree) holds at most
  ``max_samples`` (256) rows; it returns the tree as flat node arrays.
* Scoring: path lengths are computed with numpy per Arrow batch; trees (at most
  2*256 nodes each) are broadcast where all fit the limit, and stream past the
  rows of their group where they do not.
* Rule (contamination 'auto'): keep a row when -2^(-E[h]/c(psi)) >= -0.5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.operators import blocks as B
from protolens.operators.params import attach_params
from protolens.operators.sampling import rank_cut

EULER = 0.5772156649015329


def avg_path(n: float) -> float:
    """c(n): average path length of an unsuccessful BST search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _draw(tag: str, path: str, what: str) -> float:
    """Number in [0, 1) from the md5 of a tree's tag, a node's path (L and R from the root) and a name."""
    return int(hashlib.md5(f"{tag}|{path}|{what}".encode()).hexdigest()[:8], 16) / 2.0 ** 32


def _fit_tree(x: np.ndarray, tag: str, max_depth: int):
    """Node arrays of an isolation tree.  The split of a node is drawn from its path, so it is the same on every retry and
    can be drawn again elsewhere: feature number floor(u * usable) of the features that vary, threshold lo + u' (hi - lo)."""
    feat, thr, left, right, size = [], [], [], [], []

    def build(idx: np.ndarray, path: str) -> int:
        node = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if len(path) >= max_depth or len(idx) <= 1:
            return node
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return node
        q = int(usable[int(_draw(tag, path, "feature") * usable.size)])
        t = float(lo[q] + _draw(tag, path, "threshold") * (hi[q] - lo[q]))
        mask = sub[:, q] < t
        feat[node], thr[node] = q, t
        left[node] = build(idx[mask], path + "L")
        right[node] = build(idx[~mask], path + "R")
        return node

    build(np.arange(x.shape[0]), "")
    return feat, thr, left, right, size


def _path_lengths(x: np.ndarray, tree) -> np.ndarray:
    feat, thr, left, right, size = (np.asarray(a) for a in tree)
    node = np.zeros(x.shape[0], dtype=np.int64)
    depth = np.zeros(x.shape[0], dtype=np.float64)
    active = feat[node] >= 0
    while active.any():
        nd = node[active]
        go_left = x[active, feat[nd]] < thr[nd]
        node[active] = np.where(go_left, left[nd], right[nd])
        depth[active] += 1.0
        active = feat[node] >= 0
    leaf_sizes = size[node]
    sizes, at = np.unique(leaf_sizes, return_inverse=True)
    return depth + np.array([avg_path(s) for s in sizes])[at]


def fit_forests(df: DataFrame, keys: Sequence[str], id_col: str = "example_id", vec: str = "vector",
                n_trees: int = 100, max_samples: int = 256, seed: int = 42) -> DataFrame:
    """One isolation forest per group: (keys..., tree, psi, feat, thr, left, right, size)."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # acceptance rate with a wide margin; the exact cut below takes the first psi rows per tree
    rate = F.least(F.lit(1.0), (F.lit(float(max_samples)) * 1.5 + 64) / F.col("_n"))
    j = attach_params(df, counts, keys)
    u = lambda t: (F.pmod(F.xxhash64(F.col(id_col), t, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: u(t) < F.col("_rate"))
    cand = j.withColumn("_rate", rate).select(*keys, id_col, vec, "_n", F.explode(trees).alias("tree"))
    cand = cand.withColumn("_h", F.sha2(F.concat_ws(":", F.col(id_col).cast("string"), F.col("tree").cast("string"),
                                                    F.lit(str(seed))), 256))
    picked = rank_cut(cand, keys + ["tree"], "_h", id_col, max_samples, "_r")
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("tree", T.IntegerType()), T.StructField("psi", T.IntegerType()),
        T.StructField("feat", T.ArrayType(T.IntegerType())), T.StructField("thr", T.ArrayType(T.DoubleType())),
        T.StructField("left", T.ArrayType(T.IntegerType())), T.StructField("right", T.ArrayType(T.IntegerType())),
        T.StructField("size", T.ArrayType(T.IntegerType()))])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h")
        x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        psi = x.shape[0]
        key_vals = [pdf[k].iloc[0] for k in keys]
        tree_id = int(pdf["tree"].iloc[0])
        tag = "|".join([*(str(v) for v in key_vals), str(tree_id), str(seed)])
        f, t, le, ri, sz = _fit_tree(x, tag, max(1, math.ceil(math.log2(max(psi, 2)))))
        return pd.DataFrame([{**dict(zip(keys, key_vals)), "tree": tree_id, "psi": psi, "feat": f, "thr": t,
                              "left": le, "right": ri, "size": sz}], columns=[s.name for s in schema.fields])

    return picked.select(*keys, "tree", "_h", vec).groupBy(*keys, "tree").applyInPandas(fit, schema)


def _route(x: np.ndarray, blocks: list, state: dict) -> None:
    """Add the path lengths of the rows in each tree: state 0 their sum, 1 the number of trees, 2 their sample size."""
    for _, _, _, numbers in blocks:
        feat, thr, left, right, size = numbers[1:].reshape(5, -1)
        total = state.setdefault(0, np.zeros(len(x)))
        total += _path_lengths(x, (feat.astype(np.int64), thr, left.astype(np.int64), right.astype(np.int64), size))
        state[1] = state.get(1, np.zeros(len(x))) + 1
        state[2] = np.full(len(x), numbers[0])


def outlier_scores(df: DataFrame, forests: DataFrame, keys: Sequence[str], vec: str = "vector",
                   max_broadcast_bytes: int | None = None) -> DataFrame:
    """Anomaly score -2^(-E[h]/c(psi)) of every row under its own group's forest, and ``keep`` (score >= -0.5).

    A tree is a block of numbers: forests within the broadcast limit are broadcast once, larger ones stream past the
    rows of their group (``blocks.score``), so no size of forest aborts or is held whole.
    """
    keys = list(keys)
    as_double = lambda c: F.col(c).cast("array<double>")
    trees = forests.select(*keys, "tree", F.concat(F.array(F.col("psi").cast("double")), as_double("feat"), as_double("thr"),
                                                   as_double("left"), as_double("right"), as_double("size")).alias("_nodes"))
    blocks = B.vector_blocks(trees, keys, "tree", F.col("_nodes"))
    scored = B.score(df, blocks, keys, vec, "_paths", _route, max_broadcast_bytes)
    total, n, psi = (F.element_at("_paths", i) for i in (1, 2, 3))
    harmonic = 2.0 * (F.log(psi - 1.0) + EULER) - 2.0 * (psi - 1.0) / psi
    usual = F.when(psi <= 1, 1e-12).when(psi == 2, 1.0).otherwise(harmonic)
    score = -F.pow(F.lit(2.0), -(total / n) / usual)
    return scored.select(*df.columns, score.alias("outlier_score"), (score >= -0.5).alias("keep"))


def outlier_filter(df: DataFrame, keys: Sequence[str], id_col: str = "example_id", vec: str = "vector",
                   n_trees: int = 100, max_samples: int = 256, seed: int = 42) -> DataFrame:
    """drop rows that their own class's forest flags as outliers."""
    forests = fit_forests(df, keys, id_col, vec, n_trees, max_samples, seed)
    return outlier_scores(df, forests, keys, vec).where("keep").select(*df.columns)
