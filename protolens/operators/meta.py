"""Layer stacking and supervised baselines (survey G11-G18).

The stack is fitted on a per-example feature table (one column per layer).
Its objective is liblinear's: ||w||_1 + C * sum(loss) with a penalised
intercept.  Proximal Newton needs one aggregated gradient and Hessian of
(features + 1)^2 numbers a pass and a handful of passes; any number of stacks
(C values, row subsets, feature subsets) are fitted in the same passes.
G16-G18 are pyspark.ml classifiers on the raw vectors; a forest too large for
the driver is grown in tables (``forest``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolens.operators import forest
from protolens.operators.params import materialize


class Stack(NamedTuple):
    """Weights of the features, then the intercept, and the largest violation of the optimality conditions."""

    coefficients: DenseVector
    violation: float


class Problem(NamedTuple):
    """One stack to fit: its C, the rows that belong to it (all by default) and the features it may use (all by default)."""

    C: float = 1.0
    rows: Column | None = None
    columns: Sequence[str] | Sequence[int] | None = None


#: step lengths whose losses a pass also measures, beside the whole step
SHORTER = (0.25, 0.0625)
MAX_PASSES = 200
#: largest violation of the optimality conditions of |w| + C sum(loss) at which a fit ends
VIOLATION = 1e-10


def intercept(model: Stack) -> float:
    return float(model.coefficients[len(model.coefficients) - 1])


def _derivatives(rows: DataFrame, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums over the rows of each problem (first axis): loss at ``other``[:, t], loss, gradient and Hessian at ``at``.

    One scan; a task sends one row of problems x (features + 1)^2 numbers."""
    problems, p = at.shape
    trials = other.shape[1]
    shape = [(problems, trials), (problems,), (problems, p), (problems, p, p)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(s) for s in shape]
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = np.column_stack([np.asarray(b.column("x").flatten()).reshape(n, -1), np.ones(n)])
            y, member = np.asarray(b.column("y")), np.asarray(b.column("member").flatten()).reshape(n, -1)
            for k in range(problems):
                xk, yk = (x, y) if member[:, k].all() else (x[member[:, k]], y[member[:, k]])
                z = xk @ at[k]
                chance = 0.5 * (1 + np.tanh(z / 2))
                sums[0][k] += [(np.logaddexp(0, v) - yk * v).sum() for v in (xk @ w for w in other[k])]
                sums[1][k] += (np.logaddexp(0, z) - yk * z).sum()
                sums[2][k] += xk.T @ (chance - yk)
                sums[3][k] += xk.T @ (xk * (chance * (1 - chance))[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([s.ravel() for s in sums])], pa.list_(pa.float64()))], ["v"])

    row = rows.mapInArrow(run, "v array<double>").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).first()
    flat, out = np.array(row.v if row and row.v else np.zeros(sum(int(np.prod(s)) for s in shape))), []
    for s in shape:
        size = int(np.prod(s))
        out.append(flat[:size].reshape(s))
        flat = flat[size:]
    return tuple(out)


def _violations(w: np.ndarray, g: np.ndarray, allowed: np.ndarray) -> float:
    """Largest violation of the optimality conditions; ``g``: gradient of C sum(loss)."""
    v = np.where(w != 0, np.abs(g + np.sign(w)), np.maximum(np.abs(g) - 1, 0))
    return float(np.where(allowed, v, 0).max(initial=0.0))


def _newton_step(w: np.ndarray, g: np.ndarray, h: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """argmin over d of g d + d h d / 2 + |w + d| (a problem of features + 1 numbers).

    Coordinate descent finds which weights are zero and the signs of the others; a linear system gives these exactly,
    and its solution is taken once it has the same signs and no zero weight wants to move."""
    h = h + np.eye(len(w)) * (1e-12 * max(np.trace(h), 1e-300) / len(w) + 1e-300)
    d, hd, use = np.where(allowed, 0.0, -w), np.zeros_like(w), np.flatnonzero(allowed)
    hd = h @ d
    for _ in range(400):
        before = d.copy()
        for _ in range(25):
            for j in use:
                u = w[j] + d[j] - (g[j] + hd[j]) / h[j, j]
                new = np.sign(u) * max(abs(u) - 1 / h[j, j], 0.0) - w[j]
                if new != d[j]:
                    hd += (new - d[j]) * h[:, j]
                    d[j] = new
        on = allowed & (w + d != 0)
        sign = np.sign(w + d)
        off = ~on
        exact = -w.copy()
        if on.any():
            right = -(g[on] + sign[on]) + h[np.ix_(on, off)] @ w[off]
            exact[on] = np.linalg.lstsq(h[np.ix_(on, on)], right, rcond=None)[0]
        slope = g + h @ exact
        if (np.sign(w + exact)[on] == sign[on]).all() and (np.abs(slope[off & allowed]) <= 1 + 1e-9).all():
            return exact
        if np.abs(d - before).max() <= 1e-14 * max(1.0, np.abs(d).max()):
            break
    return d


def fit_stacks(features: DataFrame, feature_cols: Sequence[str], label: str, problems: Sequence[Problem]) -> list[Stack]:
    """L1 logistic stacks, all problems in the same passes (proximal Newton).

    A pass gives every problem its loss, gradient and Hessian; the step minimises their quadratic model with the L1 term,
    and is shortened where the loss does not fall enough.  Rows without all features take no part.
    """
    feature_cols = list(feature_cols)
    x = F.array(*[F.col(c).cast("double") for c in feature_cols])
    return fit_array_stacks(features, x, feature_cols, label, problems)


def fit_array_stacks(features: DataFrame, x: Column, names: Sequence, label: str, problems: Sequence[Problem]) -> list[Stack]:
    """``fit_stacks`` on an array column; ``names`` are what the problems call its entries."""
    member = F.array(*[F.lit(True) if q.rows is None else F.coalesce(q.rows, F.lit(False)) for q in problems])
    rows = features.select(x.alias("x"), F.col(label).cast("double").alias("y"), member.alias("member"))
    rows = materialize(rows.where(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))))
    size, p = len(problems), len(names) + 1
    C = np.array([q.C for q in problems])
    allowed = np.array([[q.columns is None or c in q.columns for c in names] + [True] for q in problems])
    w, step = np.zeros((size, p)), np.zeros((size, p))
    value, g, h = np.full(size, np.inf), np.zeros((size, p)), np.zeros((size, p, p))
    stale, left = np.zeros(size, bool), np.full(size, np.inf)
    for _ in range(MAX_PASSES):
        shorter, loss, new_g, new_h = _derivatives(rows, w + step, np.stack([w + a * step for a in SHORTER], axis=1))
        for k in range(size):
            whole = C[k] * loss[k] + np.abs(w[k] + step[k]).sum()
            promised = C[k] * (g[k] @ step[k]) + np.abs(w[k] + step[k]).sum() - np.abs(w[k]).sum()
            if stale[k] or not step[k].any() or whole <= value[k] + 0.01 * promised + 1e-12 * abs(value[k]):
                w[k], value[k], g[k], h[k], stale[k] = w[k] + step[k], whole, new_g[k], new_h[k], False
                left[k] = _violations(w[k], C[k] * g[k], allowed[k])
                step[k] = 0 if left[k] <= VIOLATION * max(1.0, C[k]) else _newton_step(w[k], C[k] * g[k], C[k] * h[k], allowed[k])
                continue
            values = [C[k] * s + np.abs(w[k] + a * step[k]).sum() for a, s in zip(SHORTER, shorter[k])]
            best = int(np.argmin(values))
            if values[best] < value[k]:  # go there; its derivatives come with the next pass
                w[k], value[k], step[k], stale[k] = w[k] + SHORTER[best] * step[k], values[best], 0, True
            else:
                step[k] *= SHORTER[-1] / 4
                if np.abs(step[k]).max() < 1e-14:
                    step[k] = 0
        if not step.any() and not stale.any():
            break
    return [Stack(Vectors.dense(w[k]), float(left[k])) for k in range(size)]


def meta_fit(features: DataFrame, feature_cols: Sequence[str], label: str = "label", C: float = 1.0) -> Stack:
    """L1 logistic regression over layer features (liblinear-style C)."""
    return fit_stacks(features, feature_cols, label, [Problem(C)])[0]


def stack_score(model: Stack, feature_cols: Sequence[str]) -> Column:
    """P(class 1) of a fitted stack."""
    w = [float(v) for v in model.coefficients]
    z = reduce(lambda a, cw: a + F.col(cw[0]) * F.lit(cw[1]), zip(feature_cols, w), F.lit(w[-1]))
    return 1.0 / (1.0 + F.exp(-z))


def meta_predict(model: Stack, features: DataFrame, feature_cols: Sequence[str], out: str = "meta_score") -> DataFrame:
    """P(class 1) from the stacked model, null where a feature is."""
    return features.withColumn(out, stack_score(model, feature_cols))


# The C grid of the regularisation sweep, in the reference's order.
REGULARISATION_CS = (0.0001, 0.001, 0.005, 0.05, 0.01, 0.5, 1, 10)


def regularisation_path(features: DataFrame, feature_cols: Sequence[str], label: str = "label",
                        cs: Sequence[float] = REGULARISATION_CS) -> list[tuple[float, Stack]]:
    """One stack per C, all fitted in the same passes."""
    return list(zip(cs, fit_stacks(features, feature_cols, label, [Problem(c) for c in cs])))


def meta_coefficients(spark, model, layers: Sequence[int], C: float | None = None,
                      layer_source: DataFrame | None = None) -> DataFrame:
    """Layer -> weight (numeric layer order, see Q11); a parameter-sized table.

    With ``layer_source`` (a table with a ``layer`` column, e.g. the fitted
    parameters) the rows are that table's layers with their weight looked up.
    """
    coefs = [float(w) for w in model.coefficients.toArray().tolist()[:-1]]  # the last one is the intercept
    if layer_source is None:
        df = spark.createDataFrame([(int(layer), w) for layer, w in zip(layers, coefs)], "layer int, coefficient double")
    else:
        lookup = F.create_map(*[x for layer, w in zip(layers, coefs) for x in (F.lit(int(layer)), F.lit(w))])
        df = layer_source.select(F.col("layer").cast("int").alias("layer")).distinct() \
            .select("layer", lookup[F.col("layer")].alias("coefficient"))
    return df if C is None else df.withColumn("C", F.lit(float(C)))


def supervised_lr(train: DataFrame, vec: str = "vector", label: str = "label", C: float = 1.0):
    """L2 logistic regression with C = 1."""
    data = train.select(array_to_vector(vec).alias("features"), F.col(label).cast("double").alias("label"))
    n = data.count()
    return LogisticRegression(elasticNetParam=0.0, regParam=1.0 / (C * n), standardization=False,
                              maxIter=200).fit(data)


#: trees of the random forest
TREES = 100
#: rows times trees up to which the trees are held in the driver; a full tree has about a node a row
DEFAULT_MAX_DRIVER_NODES = 1_000_000


def supervised_rf(train: DataFrame, vec: str = "vector", label: str = "label", seed: int = 42):
    """100 trees, sqrt(d) features per split (Spark caps depth at 30).

    Rows keep the id of their node in each tree, so a level's tasks do not get the trees grown so far; the forest is the same.
    Trees that would fill the driver are grown and kept in tables (``forest``): a forest of the same kind with draws of its own."""
    data = train.select(array_to_vector(vec).alias("features"), F.col(label).cast("double").alias("label"))
    most = int(train.sparkSession.conf.get("protolens.maxDriverNodes", str(DEFAULT_MAX_DRIVER_NODES)))
    if train.count() * TREES > most:
        return forest.fit(train, vec, label, TREES, seed)
    return RandomForestClassifier(numTrees=TREES, featureSubsetStrategy="sqrt", maxDepth=30, seed=seed, cacheNodeIds=True).fit(data)


def supervised_gbt(train: DataFrame, vec: str = "vector", label: str = "label", seed: int = 42):
    """100 boosting rounds of depth-6 trees."""
    data = train.select(array_to_vector(vec).alias("features"), F.col(label).cast("double").alias("label"))
    return GBTClassifier(maxIter=100, maxDepth=6, stepSize=0.3, seed=seed).fit(data)


def predict_vectors(model, df: DataFrame, vec: str = "vector", out: str = "score") -> DataFrame:
    if isinstance(model, forest.Forest):
        return forest.predict(model, df, vec, out)
    data = df.withColumn("_features", array_to_vector(vec))
    m = model.copy().setFeaturesCol("_features").setPredictionCol("_pred").setProbabilityCol("_prob") \
        .setRawPredictionCol("_raw")
    s = m.transform(data)
    return s.withColumn(out, vector_to_array("_prob")[1]).drop("_features", "_pred", "_prob", "_raw")
