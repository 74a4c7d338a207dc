"""Class prototypes and covariance statistics (survey A1-A15).

Design
------
* Means are JVM aggregates (``Summarizer``) with map-side partial aggregation.
* Scatter matrices are additive sufficient statistics: every input partition
  turns its rows into one partial Gram matrix per group with numpy BLAS
  (``mapInPandas``, Arrow batches); partials are merged by a JVM
  ``Summarizer.sum`` keyed by (group, row index).  The shuffle volume is
  ``#partitions x d^2`` per group and independent of the row count.
* Rows are centred by their own class mean before the Gram (two passes),
  which avoids the ``G - n mu mu^T`` cancellation for vectors with a large
  common offset.
* Example rows reach Python only as Arrow batches inside ``mapInPandas``
  (partial Grams); ``applyInPandas`` groups are parameter-sized (one d x d
  matrix for an inverse or eigen-decomposition), never a group of examples.
* For wide vectors the vector table should be stored partitioned by
  ``layer`` so that one input split holds one layer and a task keeps at most
  (#classes x d^2) doubles of partial state.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protolens.functions import vec as V
from protolens.operators.params import attach_params, materialize


def _inv_dof(n) -> Column:
    """1 / (n - 1), NaN when n <= 1 (a one-row class has no covariance; NaN as in float arithmetic)."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 1, F.lit(1.0) / (n - 1)).otherwise(F.lit(float("nan")))


def _keys(keys: Sequence[str] | str | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def _field_types(df: DataFrame, cols: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in cols]


# ---------------------------------------------------------------- A1, A2
def class_means(df: DataFrame, keys=("layer",), label: str = "label", vec: str = "vector") -> DataFrame:
    """A1/A2: (keys..., label, n, mean) - mean vector and count per class."""
    keys = _keys(keys)
    return df.groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("n"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("mean"),
    )


def class_counts(df: DataFrame, keys=("layer",), label: str = "label") -> DataFrame:
    """A2: n_k per class and N per group."""
    keys = _keys(keys)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return (
        df.groupBy(*keys, label)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_total", F.sum("n").over(w))
    )


# ---------------------------------------------------------------- partial Grams
GRAM_STATE_BUDGET_BYTES = 512 * 1024 * 1024


def gram_partials(df: DataFrame, group_cols: Sequence[str], vec: str = "vector",
                  state_budget_bytes: int = GRAM_STATE_BUDGET_BYTES, one_at_a_time: bool = False) -> DataFrame:
    """Per input partition and group: n, column sums s_i and Gram rows g_i (numpy BLAS).

    A task keeps one d x d accumulator per group it has seen; when they exceed
    ``state_budget_bytes`` the oldest accumulators are emitted early (partials
    are additive, so this only adds rows to the shuffle, never changes results).
    With ``one_at_a_time`` rows are sorted by group within their partition: a
    task holds one matrix and emits each group once, however many groups there are.
    Output: (group_cols..., i INT, n BIGINT, s DOUBLE, g ARRAY<DOUBLE>).
    """
    group_cols = list(group_cols)
    out_schema = T.StructType(
        _field_types(df, group_cols)
        + [
            T.StructField("i", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("s", T.DoubleType()),
            T.StructField("g", T.ArrayType(T.DoubleType())),
        ]
    )

    def emit(key, n, s, g) -> pd.DataFrame:
        d = s.shape[0]
        rows = {c: [key[j]] * d for j, c in enumerate(group_cols)}
        rows.update(i=np.arange(d, dtype=np.int32), n=np.full(d, n, dtype=np.int64), s=s, g=list(g))
        return pd.DataFrame(rows)

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, list] = {}  # insertion-ordered: oldest first
        held = 0
        for pdf in batches:
            if pdf.empty:
                continue
            for key, part in pdf.groupby(group_cols, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                x = np.asarray(np.stack(part[vec].to_numpy()), dtype=np.float64)
                st = acc.get(key)
                if one_at_a_time and st is None and acc:  # sorted: the group before is complete
                    old, (n, s, g) = acc.popitem()
                    held -= g.nbytes
                    yield emit(old, n, s, g)
                if st is None:
                    acc[key] = [x.shape[0], x.sum(axis=0), x.T @ x]
                    held += acc[key][2].nbytes
                else:
                    st[0] += x.shape[0]
                    st[1] += x.sum(axis=0)
                    st[2] += x.T @ x
            while held > state_budget_bytes and len(acc) > 1:
                old = next(iter(acc))
                n, s, g = acc.pop(old)
                held -= g.nbytes
                yield emit(old, n, s, g)
        for key, (n, s, g) in acc.items():
            yield emit(key, n, s, g)

    rows = df.select(*group_cols, vec)
    return (rows.sortWithinPartitions(*group_cols) if one_at_a_time else rows).mapInPandas(per_partition, out_schema)


def merge_gram(partials: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Sum partial Grams by (group, i) in the JVM: (group..., i, n, s, g)."""
    return partials.groupBy(*group_cols, "i").agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        vector_to_array(Summarizer.sum(array_to_vector(F.col("g")))).alias("g"),
    )


def _rows_to_scatter(merged: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Scatter rows G_i - s_i s / n from merged Gram rows; (group..., i, n, row).

    The column-sum vector s is gathered with a window over the d rows of one
    matrix (bounded by d), so no join is needed.
    """
    group_cols = list(group_cols)
    w = Window.partitionBy(*group_cols)
    svec = F.transform(F.array_sort(F.collect_list(F.struct("i", "s")).over(w)), lambda t: t["s"])
    row = F.zip_with("g", "_svec", lambda g, sj: g - F.col("s") * sj / F.col("n"))
    return merged.withColumn("_svec", svec).select(*group_cols, "i", "n", row.alias("row"))


# ---------------------------------------------------------------- A3, A4
def class_scatter(
    df: DataFrame,
    keys=("layer",),
    label: str = "label",
    vec: str = "vector",
    means: DataFrame | None = None,
    means_materialized: bool = False,
) -> DataFrame:
    """Per-class scatter sum_{i in k}(x - mu_k)(x - mu_k)^T as rows: (keys..., label, i, n, row)."""
    keys = _keys(keys)
    if means is None:
        means = class_means(df, keys, label, vec)
    means = means.select(*keys, label, "mean")
    if not means_materialized:
        means = materialize(means)  # pass 1 over the rows, computed once
    centred = attach_params(df.select(*keys, label, vec), means, keys + [label], materialized=True)
    centred = centred.select(*keys, label, V.sub(vec, "mean").alias(vec))
    info = means.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("mean")).alias("d")).first()
    many = (info.k or 0) * (info.d or 0) ** 2 * 8 > GRAM_STATE_BUDGET_BYTES
    merged = merge_gram(gram_partials(centred, keys + [label], vec, one_at_a_time=many), keys + [label])
    return _rows_to_scatter(merged, keys + [label])


def class_covariance(scatter: DataFrame, keys=("layer",), label: str = "label") -> DataFrame:
    """A4: per-class covariance, divided by n_k - 1: (keys..., label, i, n, row)."""
    keys = _keys(keys)
    return scatter.select(
        *keys, label, "i", "n", V.scale("row", _inv_dof("n")).alias("row")
    )


def pooled_covariance(scatter: DataFrame, keys=("layer",)) -> DataFrame:
    """A3: sum_k scatter_k / (N - 1) (N - 1, not N - K, as in the reference): (keys..., i, n, row)."""
    keys = _keys(keys)
    tot = scatter.groupBy(*keys, "i").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector(F.col("row")))).alias("row")
    )
    return tot.select(*keys, "i", "n", V.scale("row", _inv_dof("n")).alias("row"))


def diag_norm_scaling(cov: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """A5: cov / sqrt(sum_i cov_ii^2) per matrix (a scalar scaling, kept from the reference)."""
    group_cols = list(group_cols)
    diag = cov.select(*group_cols, F.element_at("row", F.col("i") + 1).alias("cii"))
    nrm = diag.groupBy(*group_cols).agg(F.sqrt(F.sum(F.col("cii") * F.col("cii"))).alias("dnorm"))
    j = attach_params(cov, nrm, group_cols)
    return j.select(*group_cols, "i", "n", V.scale("row", V.fdiv(1.0, "dnorm")).alias("row"))


# ---------------------------------------------------------------- A6, A7
def _matrix_schema(cov: DataFrame, group_cols: Sequence[str]) -> T.StructType:
    return T.StructType(
        _field_types(cov, group_cols)
        + [
            T.StructField("i", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("row", T.ArrayType(T.DoubleType())),
        ]
    )


def bayes_precision(cov: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """D * ((n - 1) C + tr(C) I)^-1 per matrix; one d x d task per group, no example rows."""
    group_cols = list(group_cols)

    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        c = np.stack(pdf["row"].to_numpy()).astype(np.float64)
        d = c.shape[0]
        n = int(pdf["n"].iloc[0])
        try:
            p = d * np.linalg.inv((n - 1) * c + np.trace(c) * np.eye(d))
        except np.linalg.LinAlgError:  # singular (e.g. a one-row class): no precision, as NaN
            p = np.full((d, d), np.nan)
        out = pdf[group_cols + ["i", "n"]].copy()
        out["row"] = list(p)
        return out

    return cov.groupBy(*group_cols).applyInPandas(invert, _matrix_schema(cov, group_cols))


def class_precisions(cov_by_class: DataFrame, keys=("layer",), label: str = "label") -> DataFrame:
    """A6 per class with n_k."""
    return bayes_precision(cov_by_class, _keys(keys) + [label])


# ---------------------------------------------------------------- A8
def gda_params(means: DataFrame, precision: DataFrame, keys=("layer",), label: str = "label") -> DataFrame:
    """W_k = mu_k P, b_k = log(1/K) - 1/2 mu_k^T P mu_k: (keys..., label, w, b)."""
    keys = _keys(keys)
    mu_i = means.select(*keys, label, F.posexplode("mean").alias("i", "mu_i")).withColumn(
        "i", F.col("i").cast("int")
    )
    contrib = mu_i.join(precision.select(*keys, "i", "row"), keys + ["i"])
    w = contrib.groupBy(*keys, label).agg(
        vector_to_array(Summarizer.sum(array_to_vector(V.scale("row", F.col("mu_i"))))).alias("w")
    )
    k = means.groupBy(*keys).agg(F.count(F.lit(1)).alias("k_classes"))
    j = w.join(means.select(*keys, label, "mean"), keys + [label]).join(k, keys)
    return j.select(
        *keys,
        label,
        "w",
        (F.log(1.0 / F.col("k_classes")) - 0.5 * V.dot("w", "mean")).alias("b"),
    )


def fit_gda(
    df: DataFrame,
    keys=("layer",),
    label: str = "label",
    vec: str = "vector",
    per_class: bool = False,
    scale_covariances: bool = False,
) -> dict[str, DataFrame]:
    """Means, pooled (and per-class) covariance, precisions and GDA parameters in one plan."""
    keys = _keys(keys)
    # every stage below is parameter-sized (K x d or d x d per key) and reused, so it is materialized once
    means = materialize(class_means(df, keys, label, vec))
    scatter = materialize(class_scatter(df, keys, label, vec, means, means_materialized=True))
    pooled = pooled_covariance(scatter, keys)
    out = {"means": means, "scatter": scatter, "pooled": pooled}
    out["precision"] = materialize(bayes_precision(pooled, keys))
    out["params"] = materialize(gda_params(means, out["precision"], keys, label))
    if per_class:
        cc = class_covariance(scatter, keys, label)
        if scale_covariances:
            cc = diag_norm_scaling(cc, keys + [label])
        out["class_cov"] = cc
        out["class_precision"] = class_precisions(cc, keys, label)
    return out


# ---------------------------------------------------------------- A11, A12
def merge_covariances(cov: DataFrame, group_cols: Sequence[str], over: str) -> DataFrame:
    """sum_j cov_j (n_j - 1) / (sum n_j - 1), merging the ``over`` dimension away."""
    group_cols = list(group_cols)
    w = cov.select(*group_cols, over, "i", "n", V.scale("row", F.col("n") - 1).alias("row"))
    tot = w.groupBy(*group_cols, "i").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector(F.col("row")))).alias("row")
    )
    return tot.select(*group_cols, "i", "n", V.scale("row", _inv_dof("n")).alias("row"))


def merge_means_weighted(means: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Sum n_j mu_j / sum n_j per group (group includes the class)."""
    group_cols = list(group_cols)
    w = means.select(*group_cols, "n", V.scale("mean", F.col("n").cast("double")).alias("m"))
    tot = w.groupBy(*group_cols).agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector(F.col("m")))).alias("m")
    )
    return tot.select(*group_cols, "n", V.scale("m", 1.0 / F.col("n")).alias("mean"))


# ---------------------------------------------------------------- A13, A14, A15
def combination_name(mask: Column, names: Sequence[str]) -> Column:
    """Names of the datasets in a set, joined by '+'; bit r of ``mask`` stands for ``names[r]``."""
    named = F.transform(F.array(*[F.lit(n) for n in names]), lambda n, r: F.when(_has(mask, r), n))
    return F.array_join(named, "+")  # nulls are left out


def _has(mask: Column, r: Column) -> Column:
    return F.call_function("shiftright", mask, r.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _position(names: Sequence[str], dataset: str) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(dataset)) - 1


def combination_sums(table: DataFrame, keys: Sequence[str], names: Sequence[str], vec: str, dataset: str = "dataset",
                     masks: Sequence[int] | None = None) -> DataFrame:
    """(keys, mask, n, vec): ``n`` and ``vec`` summed over every non-empty set of datasets (over ``masks`` when given).

    ``table`` has one row for each key and dataset.  The rows of a key, at most one a dataset, are gathered; the sets are
    walked depth first, so each is one vector addition to the set without its last member, and only the sums
    on the way to a set are held.  Sets that hold no dataset of a key give no row.
    """
    keys, k = list(keys), len(names)
    if k > 62:
        raise ValueError("sets of more than 62 datasets do not fit a 64-bit mask")
    wanted = None if masks is None else {int(m) for m in masks}
    member = F.struct(_position(names, dataset).cast("int").alias("r"), F.col("n").cast("long").alias("n"), F.col(vec).alias("v"))
    gathered = table.where(_position(names, dataset) >= 0).groupBy(*keys).agg(F.collect_list(member).alias("_rows"))
    schema = T.StructType(_field_types(table, keys) + [T.StructField("mask", T.LongType()), T.StructField("n", T.LongType()),
                                                       T.StructField(vec, T.ArrayType(T.DoubleType()))])

    def walk(rows: dict, r: int, mask: int, held: bool, n: int, v: np.ndarray) -> Iterator[tuple]:
        for q in range(r, k):
            now, here = mask | 1 << q, held or q in rows
            total = (n + rows[q][0], v + rows[q][1]) if q in rows else (n, v)
            if here and (wanted is None or now in wanted):
                yield now, *total
            yield from walk(rows, q + 1, now, here, *total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field(c).type for c in keys]
            for i in range(b.num_rows):
                of = b.column("_rows").slice(i, 1).flatten()
                values = of.field("v")
                rows = {r: (n, np.asarray(values[j].values, dtype=np.float64))
                        for j, (r, n) in enumerate(zip(of.field("r").to_pylist(), of.field("n").to_pylist()))}
                d = len(next(iter(rows.values()))[1])
                key, step = [b.column(c)[i].as_py() for c in keys], max(1, (4 << 20) // (8 * d))
                sums = walk(rows, 0, 0, False, 0, np.zeros(d))
                while part := list(itertools.islice(sums, step)):
                    m = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([x] * m, t) for x, t in zip(key, types)), pa.array([x for x, _, _ in part], pa.int64()),
                         pa.array([n for _, n, _ in part], pa.int64()),
                         pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * d, pa.int32()), pa.array(np.concatenate([v for _, _, v in part])))],
                        [*keys, "mask", "n", vec])

    return gathered.mapInArrow(run, schema)


def merge_combination_covariances(cov: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """A11 for every set of datasets: sum_j cov_j (n_j - 1) / (sum n_j - 1): (mask, keys, i, n, row)."""
    keys = list(keys)
    weighted = cov.select(*keys, "dataset", "i", "n", V.scale("row", (F.col("n") - 1).cast("double")).alias("row"))
    sums = combination_sums(weighted, [*keys, "i"], names, "row")
    return sums.select("mask", *keys, "i", "n", V.scale("row", _inv_dof("n")).alias("row"))


def merge_combination_means(means: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """A12 for every set of datasets: sum n_j mu_j / sum n_j: (mask, keys, n, mean); keys include the class."""
    keys = list(keys)
    sums = combination_sums(means.select(*keys, "dataset", "n", V.scale("mean", F.col("n").cast("double")).alias("mean")), keys, names, "mean")
    return sums.select("mask", *keys, "n", V.scale("mean", 1.0 / F.col("n")).alias("mean"))


def dataset_masks(names: Sequence[str], dataset: str = "dataset") -> Column:
    """All sets that hold the row's dataset, as an array of masks."""
    last = (1 << len(names)) - 1
    return F.filter(F.sequence(F.lit(1).cast("long"), F.lit(last).cast("long")), lambda m: _has(m, _position(names, dataset)))


def dataset_combinations(spark, datasets: Sequence[str], fixed: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Every non-empty subset (or a fixed list) as (combo STRING, dataset STRING, combo_size INT) rows, made in Spark."""
    names = list(datasets)
    if fixed is not None:
        rows = [("+".join(c), d, len(c)) for c in fixed for d in c]
        return spark.createDataFrame(rows, "combo string, dataset string, combo_size int")
    one = spark.createDataFrame([(n,) for n in names], "dataset string")
    sets = one.select("dataset", F.explode(dataset_masks(names)).alias("m"))
    return sets.select(combination_name(F.col("m"), names).alias("combo"), "dataset", F.bit_count("m").cast("int").alias("combo_size"))


def stack_prototypes(means: DataFrame, datasets: Sequence[str], keys=("layer",), label: str = "label") -> DataFrame:
    """Prototypes of the datasets of every set stacked; proto_id re-ranked, class = proto_id mod 2."""
    keys, names = _keys(keys), list(datasets)
    j = means.where(F.col("dataset").isin(names)).withColumn("mask", F.explode(dataset_masks(names)))
    w = Window.partitionBy("mask", *keys).orderBy("dataset", label)  # the prototypes of one set
    return j.select(
        combination_name(F.col("mask"), names).alias("combo"), "mask", *keys, "dataset", label, "n", "mean",
        (F.row_number().over(w) - 1).cast("int").alias("proto_id")
    ).withColumn("proto_class", (F.col("proto_id") % 2).cast("int"))


def incremental_steps(df: DataFrame, category: str = "category", max_step: int | None = None) -> DataFrame:
    """A15 helper: rows of category c appear in every step i >= c (1 <= i <= max_step).

    Sufficient statistics are additive, so callers aggregate per category once and
    sum partials per step instead of rescanning rows per step.
    """
    first = F.greatest(F.col(category).cast("int"), F.lit(1))
    steps = F.sequence(first, F.lit(int(max_step)))
    # categories above the last step belong to no step (sequence would otherwise count down)
    return df.where(first <= F.lit(int(max_step))).withColumn("step", F.explode(steps))


def fit_gda_steps(df: DataFrame, keys=("layer",), category: str = "category", max_step: int = 1,
                  vec: str = "vector") -> dict[str, DataFrame]:
    """A15 + A6/A8 for every category step at once: step i uses categories 0..i as classes.

    Means and scatter are computed once per category; each step's pooled
    covariance sums the partials of its categories, and the precision and GDA
    parameters are fitted per (step, keys) in one grouped job.
    """
    keys = _keys(keys)
    means = materialize(class_means(df, keys, category, vec))
    scatter = materialize(class_scatter(df, keys, category, vec, means, means_materialized=True))
    stepped = incremental_steps(scatter, category, max_step).drop(category)
    pooled = pooled_covariance(stepped, keys + ["step"])
    precision = materialize(bayes_precision(pooled, keys + ["step"]))
    stepped_means = incremental_steps(means, category, max_step)
    params = materialize(gda_params(stepped_means, precision, keys + ["step"], category))
    return {"means": means, "precision": precision, "params": params}
