"""Result analytics over score tables (survey D1-D18)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def path_field(col, kind: str) -> Column:
    """D1: '10_samples' -> 10, 'C_0.01' -> 0.01, 'layer_7' -> 7 (``kind`` in samples / C / layer / seed)."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, "_")
    if kind == "samples":
        return F.try_element_at(parts, F.lit(1)).try_cast("int")
    if kind == "C":
        return F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.try_element_at(parts, F.lit(-1)).try_cast("int")


def headline_score(dataset_type: str = "dataset_type", f1: str = "f1", accuracy: str = "accuracy") -> Column:
    """F1 on harmful sets, accuracy on benign sets."""
    return F.when(F.col(dataset_type) == "harmful", F.col(f1)).otherwise(F.col(accuracy))


def mean_by_group(df: DataFrame, keys: Sequence[str], value: str, out: str = "mean_score") -> DataFrame:
    """D3 / D17."""
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def mean_std_by_group(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample standard deviation."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def layers_used(coefs: DataFrame, keys: Sequence[str], coef: str = "coefficient", eps: float = 1e-5) -> DataFrame:
    """Number of coefficients with |w| > eps."""
    return coefs.groupBy(*keys).agg(F.sum((F.abs(F.col(coef)) > eps).cast("int")).cast("int").alias("layers_used"))


def normalised_coefficients(coefs: DataFrame, keys: Sequence[str], coef: str = "coefficient") -> DataFrame:
    """|w| / max |w| per group (0 when the max is 0); a group is one model's layers (bounded)."""
    w = Window.partitionBy(*keys)
    m = F.max(F.abs(F.col(coef))).over(w)
    return coefs.withColumn("normalised", F.when(m == 0, F.lit(0.0)).otherwise(F.abs(F.col(coef)) / m))


def relative_layer(df: DataFrame, n_layers: Mapping[str, int], model: str = "model", layer: str = "layer") -> DataFrame:
    """Layer / number of layers of the model (map join, parameter-sized)."""
    m = df.sparkSession.createDataFrame([(k, int(v)) for k, v in n_layers.items()], "_m string, _n int")
    j = df.join(F.broadcast(m), F.col(model) == F.col("_m"), "left")
    return j.withColumn("relative_layer", F.col(layer) / F.col("_n")).drop("_m", "_n")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns as NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "metric", val: str = "value") -> DataFrame:
    """Wide metric columns -> long rows."""
    return df.unpivot(list(ids), list(values), var, val)


def min_max_mean_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """Three summary rows (min, max, mean) per key."""
    g = df.groupBy(key).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return g.unpivot([key], ["min", "max", "mean"], "stat", "value")


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the non-null values among ``cols``."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))


def ordered_category_sort(df: DataFrame, col: str, order: Sequence[str], rank: str = "order_rank") -> DataFrame:
    """Attach the fixed rank of each category and sort by it."""
    arr = F.array(*[F.lit(x) for x in order])
    return df.withColumn(rank, F.array_position(arr, F.col(col)).cast("int")).orderBy(rank)


def pair_variants(df: DataFrame, model: str, keys: Sequence[str], value: str, suffix: str = "_inst") -> DataFrame:
    """Pretrained ('pt') and instruct ('it') rows of one base model side by side."""
    base = F.regexp_replace(F.col(model), suffix + "$", "")
    variant = F.when(F.col(model).endswith(suffix), "it").otherwise("pt")
    t = df.withColumn("base_model", base).withColumn("variant", variant)
    return t.groupBy("base_model", *keys).pivot("variant", ["pt", "it"]).agg(F.first(value))


def percent_and_rename(value, name, prefix: str = "Majority Vote ") -> tuple[Column, Column]:
    """x100 and strip a name prefix."""
    v = F.col(value) if isinstance(value, str) else value
    n = F.col(name) if isinstance(name, str) else name
    return v * 100, F.when(n.startswith(prefix), F.substr(n, F.lit(len(prefix) + 1))).otherwise(n)


def response_detection_rates(df: DataFrame, model: str, harmful_q: str, flagged: str, harmful_resp: str) -> DataFrame:
    """Per model: harmful questions, correctly flagged, harmful answers, both."""
    hq = F.col(harmful_q)
    return df.groupBy(model).agg(
        F.sum(hq.cast("int")).cast("long").alias("harmful_questions"),
        F.sum((hq & F.col(flagged)).cast("int")).cast("long").alias("classified_correctly"),
        F.sum((hq & F.col(harmful_resp)).cast("int")).cast("long").alias("harmful_responses"),
        F.sum((hq & F.col(flagged) & F.col(harmful_resp)).cast("int")).cast("long").alias("both"),
    )
