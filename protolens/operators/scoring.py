"""Scoring example rows against fitted prototypes (survey G1-G10, G19).

Parameters are packed per key (one array of per-class structs per layer) and
attached with ``attach_params`` (measured broadcast or salted join).  Per-row
arithmetic is built-in higher-order functions, so nothing leaves the JVM; for
vectors wider than ``HOF_MAX_DIM``, and for Mahalanobis distances, the same
scores are computed with numpy BLAS per Arrow batch against parameter blocks
(``engine='arrow'``, see ``blocks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.functions import vec as V
from protolens.operators import blocks as B
from protolens.operators.params import attach_params, materialize, pack_params, require_dense_ids

# Engine choice in 'auto' mode, from tools/engine_bench.py (local[8], 20k rows): the d^2-per-row Mahalanobis
# distance as higher-order functions is 4x slower than numpy at d = 16 and ~100x at d = 256, so it always runs
# on Arrow batches; the K*d-per-row logits / distances are on par up to d ~ 1024 and stay in the JVM there.
HOF_MAX_DIM = 1024


def _k(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def gda_logits(df: DataFrame, params: DataFrame, keys=("layer",), label: str = "label", vec: str = "vector",
               out: str = "logits", engine: str = "auto",
               max_broadcast_bytes: int | None = None) -> DataFrame:
    """G1: x W^T + b as an array ordered by class id.

    ``engine``: 'hof' (JVM higher-order functions), 'arrow' (numpy matmul per
    Arrow batch, for wide vectors) or 'auto' (by vector width).
    """
    keys = _k(keys)
    packed = materialize(pack_params(params, keys, label, ["w", "b"], "_gda"))
    require_dense_ids(packed, keys, "_gda")
    if engine == "auto":
        width = packed.select(F.max(F.size(F.element_at("_gda", 1)["w"]))).first()[0] or 0
        engine = "hof" if width <= HOF_MAX_DIM else "arrow"
    if engine == "arrow":
        blocks = B.vector_blocks(params, keys, label, F.concat("w", F.array(F.col("b").cast("double"))))
        return B.score(df, blocks, keys, vec, out, B.logits, max_broadcast_bytes)
    j = attach_params(df, packed, keys, materialized=True)
    return j.withColumn(out, F.transform("_gda", lambda p: V.dot(vec, p["w"]) + p["b"])).drop("_gda")


def softmax_probs(df: DataFrame, logits: str = "logits", out: str = "probs") -> DataFrame:
    """Stable row softmax."""
    return df.withColumn(out, V.softmax(logits))


def argmax_class(df: DataFrame, scores: str = "probs", out: str = "pred") -> DataFrame:
    """First index of the maximum."""
    return df.withColumn(out, V.argmax(scores))


def _arrow_distances(df: DataFrame, means: DataFrame, matrices: DataFrame, keys: list[str], label: str, cls: str | None,
                     vec: str, out: str, max_bytes: int | None, keep: Sequence[str] | None) -> DataFrame:
    """Squared Mahalanobis distances by whitening: |L^T (x - mean)|^2, added up over blocks of rows of L^T."""
    means = materialize(means.select(*keys, label, "mean"))
    require_dense_ids(pack_params(means.select(*keys, label), keys, label, [], "_ids"), keys, "_ids")
    blocks = B.vector_blocks(means, keys, label, F.col("mean")).unionByName(B.factor_blocks(matrices, keys, cls))
    return B.score(df, blocks, keys, vec, out, B.mahalanobis, max_bytes, keep)


def mahalanobis_sq(df: DataFrame, means: DataFrame, precision: DataFrame, keys=("layer",), label: str = "label",
                   vec: str = "vector", out: str = "maha", engine: str = "auto",
                   max_broadcast_bytes: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Squared Mahalanobis distance to every prototype with one shared precision per key.

    ``engine``: 'hof' (JVM higher-order functions), 'arrow' (numpy per batch, whitened by blocks of the Cholesky factor);
    'auto' is 'arrow' (see the measurements at ``HOF_MAX_DIM``).  ``keep``: columns of ``df`` to return ('arrow' only).
    """
    keys = _k(keys)
    if engine == "auto":
        engine = "arrow"  # d^2 per row: numpy BLAS wins at every measured width
    if engine == "arrow":
        return _arrow_distances(df, means, precision, keys, label, None, vec, out, max_broadcast_bytes, keep)
    mpack = pack_params(means, keys, label, ["mean"], "_mu")
    ppack = precision.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda t: t["row"]).alias("_p")
    )
    params = mpack.join(ppack, keys)
    j = attach_params(df, params, keys)
    return j.withColumn(
        out, F.transform("_mu", lambda m: V.quad_form("_p", V.sub(vec, m["mean"])))
    ).drop("_mu", "_p")


def mahalanobis_class_sq(df: DataFrame, means: DataFrame, class_precision: DataFrame, keys=("layer",),
                         label: str = "label", vec: str = "vector", out: str = "maha", engine: str = "auto",
                         max_broadcast_bytes: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Squared distance with each prototype's own precision matrix (engines as in G4)."""
    keys = _k(keys)
    if engine == "auto":
        engine = "arrow"  # d^2 per row: numpy BLAS wins at every measured width
    if engine == "arrow":
        return _arrow_distances(df, means, class_precision, keys, label, label, vec, out, max_broadcast_bytes, keep)
    pm = class_precision.groupBy(*keys, label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda t: t["row"]).alias("p")
    )
    per_class = means.select(*keys, label, "mean").join(pm, keys + [label])
    packed = pack_params(per_class, keys, label, ["mean", "p"], "_mp")
    j = attach_params(df, packed, keys)
    return j.withColumn(
        out, F.transform("_mp", lambda m: V.quad_form(m["p"], V.sub(vec, m["mean"])))
    ).drop("_mp")


def nmc_neg_distance(df: DataFrame, means: DataFrame, keys=("layer",), label: str = "label", vec: str = "vector",
                     out: str = "neg_dist", engine: str = "auto",
                     max_broadcast_bytes: int | None = None) -> DataFrame:
    """G6 input: minus the Euclidean distance to every class mean (engines as in G1)."""
    keys = _k(keys)
    packed = materialize(pack_params(means, keys, label, ["mean"], "_mu"))
    require_dense_ids(packed, keys, "_mu")
    if engine == "auto":
        width = packed.select(F.max(F.size(F.element_at("_mu", 1)["mean"]))).first()[0] or 0
        engine = "hof" if width <= HOF_MAX_DIM else "arrow"
    if engine == "arrow":
        return B.score(df, B.vector_blocks(means, keys, label, F.col("mean")), keys, vec, out, B.negative_distance, max_broadcast_bytes)
    j = attach_params(df, packed, keys, materialized=True)
    return j.withColumn(out, F.transform("_mu", lambda m: -F.sqrt(V.sq_dist(vec, m["mean"])))).drop("_mu")


def nmc_pred(df: DataFrame, means: DataFrame, keys=("layer",), label: str = "label", vec: str = "vector") -> DataFrame:
    """Softmax / argmax of minus the Euclidean distance."""
    s = nmc_neg_distance(df, means, keys, label, vec)
    return s.withColumn("probs", V.softmax("neg_dist")).withColumn("pred", V.argmax("neg_dist"))


def mahalanobis_pred(scored: DataFrame, dist: str = "maha") -> DataFrame:
    """G4/G5 predictions: softmax / argmax of minus the squared distance."""
    neg = F.transform(dist, lambda x: -x)
    return scored.withColumn("probs", V.softmax(neg)).withColumn("pred", V.argmax(neg))


def positive_score(probs: str = "probs", index: int = 1):
    """Probability of class ``index`` (0-based)."""
    return F.element_at(probs, index + 1)


def odd_class_sum(probs: str = "probs"):
    """Sum of probabilities at odd class ids."""
    return V.odd_sum(probs)


def layer_features(scores: DataFrame, id_col: str, feature_cols: Sequence[str], value: str,
                   pivot_values: Sequence) -> DataFrame:
    """Per-layer scores side by side per example (pivot over known values)."""
    feature_cols = list(feature_cols)
    if len(feature_cols) == 1:
        key = F.col(feature_cols[0]).cast("string")
    else:
        key = F.concat_ws("_", *[F.col(c).cast("string") for c in feature_cols])
    return (
        scores.withColumn("_feat", key)
        .groupBy(id_col)
        .pivot("_feat", [str(v) for v in pivot_values])
        .agg(F.first(value))
    )
