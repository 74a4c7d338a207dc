"""Leading principal axes of wide rows by block Krylov iteration, without the d x d matrix.

One pass over the rows turns a block Q of ``block`` orthonormal columns into A Q, A = Xc^T Xc / (n - 1): each task adds
Xc^T (Xc Q) up for its rows, so it sends block x d numbers a key.  The bases of all passes are kept (a table of d numbers a
column and key); Rayleigh-Ritz on them gives the axes, and the residual |A v - l v| of each says whether to go on.
The update of a key is one small task: d x (passes x block) numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.operators.blocks import _vectors
from protolens.operators.params import attach_params, materialize

BLOCK = 8
#: residual of an axis, as a part of its variance, at which it is taken
TOLERANCE = 1e-9


def _start(key: tuple, d: int, block: int) -> np.ndarray:
    """First block of a key, the same on every retry."""
    seed = int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(block, d))))[0]


def _passed(rows: DataFrame, bases: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, j, s): column j of Xc^T Xc Q summed over the rows, j = -1: sum of squares in s[0]."""
    table = bases.toArrow()  # block x d numbers a key
    columns: dict = {}
    for *key, j, v in zip(*(table.column(c).to_pylist() for c in (*keys, "j")), (np.asarray(x.values) for x in table.column("v"))):
        columns.setdefault(tuple(key), {})[j] = v
    shared = rows.sparkSession.sparkContext.broadcast({k: np.stack([c[j] for j in sorted(c)], axis=1) for k, c in columns.items()})
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("j", T.IntegerType()), T.StructField("s", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            of: dict = {}
            for at, key in enumerate(zip(*(b.column(k).to_pylist() for k in keys))):
                of.setdefault(key, []).append(at)
            for key, at in of.items():
                q = shared.value.get(key)
                if q is None:
                    continue
                x = _vectors(b.column(vec) if len(of) == 1 else b.column(vec).take(pa.array(at)))
                y, squares = x.T @ (x @ q), np.einsum("ij,ij->", x, x)
                if key in sums:
                    sums[key][0] += y
                    sums[key][1] += squares
                else:
                    sums[key] = [y, squares]
        for key, (y, squares) in sums.items():
            k = y.shape[1] + 1
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v] * k, f) for v, f in zip(key, (b.schema.field(c).type for c in keys))), pa.array(range(-1, k - 1), pa.int32()),
                 pa.array([np.eye(1, y.shape[0])[0] * squares, *y.T], pa.list_(pa.float64()))], [*keys, "j", "s"])

    sums = rows.mapInArrow(run, schema)
    return sums.groupBy(*keys, "j").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))


def _ritz(v: np.ndarray, av: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, axes, residuals) of the k largest in the span of the columns of ``v``."""
    t = v.T @ av
    w, s = np.linalg.eigh((t + t.T) / 2)
    order = np.argsort(w)[::-1][:k]
    w, s = w[order], s[:, order]
    return w, v @ s, np.linalg.norm(av @ s - (v @ s) * w, axis=0)


def krylov_directions(rows: DataFrame, keys: Sequence[str], vec: str = "vector", k: int = 1, block: int = BLOCK) -> DataFrame:
    """(keys..., component, direction, evr, variance): as ``contrast.principal_directions``, for rows of any width."""
    keys = list(keys)
    means = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("_mu"))
    means = materialize(means)
    centred = attach_params(rows.select(*keys, vec), means.select(*keys, "_mu"), keys, materialized=True)
    centred = materialize(centred.select(*keys, F.zip_with(vec, "_mu", lambda x, m: x.cast("double") - m).alias(vec)))  # read once a pass
    key_fields = [rows.schema[c] for c in keys]
    state = T.StructType([*key_fields, T.StructField("n", T.LongType()), T.StructField("step", T.IntegerType()),
                          T.StructField("j", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType())),
                          T.StructField("av", T.ArrayType(T.DoubleType())), T.StructField("total", T.DoubleType())])
    names = [f.name for f in state.fields]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                key = tuple(getattr(r, c) for c in keys)
                q = _start(key, int(r.width), block)
                yield pd.DataFrame([[*key, r.n, 0, j, q[:, j], None, None] for j in range(q.shape[1])], columns=names)

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        """Next block of a key (rows without av), or its axes: step -1, j the component, total the variance of all."""
        pdf = pdf.sort_values(["step", "j"])
        key, n, total = [pdf[c].iloc[0] for c in keys], int(pdf["n"].iloc[0]), float(pdf["total"].max())
        v, av = (np.stack(pdf[c].to_numpy()).T.astype(np.float64) for c in ("v", "av"))
        w, axes, residual = _ritz(v, av, k)
        step = int(pdf["step"].max()) + 1
        fresh = av[:, (pdf["step"] == step - 1).to_numpy()]
        for _ in range(2):  # twice is enough for orthogonality to rounding
            fresh = fresh - v @ (v.T @ fresh)
        u, size, _ = np.linalg.svd(fresh, full_matrices=False)
        u = u[:, size > 1e-12 * max(w[0], 1e-300)][:, :max(0, v.shape[0] - v.shape[1])]
        if (residual <= TOLERANCE * max(w[0], 1e-300)).all() or not u.shape[1]:
            out = []
            for c in range(axes.shape[1]):
                a = axes[:, c] / np.linalg.norm(axes[:, c])
                out.append([*key, n, -1, c, a if a[np.argmax(np.abs(a))] > 0 else -a, [w[c]], total])
            return pd.DataFrame(out, columns=names)
        u = u - v @ (v.T @ u)
        u = np.linalg.qr(u)[0]
        old = pdf[names].copy()
        new = pd.DataFrame([[*key, n, step, j, u[:, j], None, total] for j in range(u.shape[1])], columns=names)
        return pd.concat([old, new], ignore_index=True)

    widths = means.select(*keys, "n", F.size("_mu").alias("width"))
    now = materialize(widths.mapInPandas(first, state))
    done: list[DataFrame] = []
    while True:
        last = now.groupBy(*keys).agg(F.max("step").alias("_last"))
        todo = now.join(last, keys)
        newest = todo.where("step = _last")
        sums = materialize(_passed(centred, newest.select(*keys, "j", "v"), keys, vec))
        totals = sums.where("j = -1").select(*keys, F.element_at("s", 1).alias("_squares"))
        filled = todo.join(sums.where("j >= 0").withColumnRenamed("s", "_s"), [*keys, "j"], "left").join(totals, keys)
        dof = F.when(F.col("n") > 1, F.col("n") - 1).otherwise(F.lit(1)).cast("double")
        filled = filled.select(*keys, "n", "step", "j", "v",
                               F.when(F.col("step") == F.col("_last"), F.transform("_s", lambda x: x / dof)).otherwise(F.col("av")).alias("av"),
                               (F.col("_squares") / dof).alias("total"))
        stepped = materialize(filled.groupBy(*keys).applyInPandas(update, state))
        done.append(stepped.where("step = -1"))
        now = stepped.where("step >= 0")
        if now.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    variance = F.element_at("av", 1)
    return out.select(*keys, F.col("j").alias("component"), F.col("v").alias("direction"),
                      F.when(F.col("total") > 0, variance / F.col("total")).otherwise(F.lit(float("nan"))).alias("evr"), variance.alias("variance"))
