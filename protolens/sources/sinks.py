"""Sinks (survey K1-K7).  All writers are distributed, partitioned writes;
dynamic partition overwrite replaces only the partitions present in the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _writer(df: DataFrame, mode: str, partition_by=()):
    # dynamic overwrite as a per-write option: only the partitions present in ``df`` are replaced,
    # and the session configuration is left untouched
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w


def write_layer_vectors(df: DataFrame, path: str, replace: bool = True) -> None:
    """K1: one partition per (layer, pooling); ``replace`` overwrites only those partitions."""
    _writer(df, "overwrite" if replace else "append", ("layer", "pooling")).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """K2: prediction rows partitioned by benchmark."""
    _writer(df, "overwrite", ("dataset_type", "dataset")).parquet(path)


def write_scores(df: DataFrame, path: str, keys=("dataset_type", "dataset"), method: str = "method") -> None:
    """K3: one score file per benchmark, ``{method: {metric: value}}``, in a ``{keys}/`` folder.

    A benchmark's methods are a bounded group (a handful of rows).
    """
    keys = list(keys)
    metrics = [c for c in df.columns if c not in keys and c != method]
    entries = F.collect_list(F.struct(F.col(method), F.struct(*[F.col(c).cast("double").alias(c) for c in metrics])))
    rec = df.groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    _writer(rec.repartition(*keys), "overwrite", keys).text(path)


def write_meta_coefficients(df: DataFrame, path: str) -> None:
    """K4: layer -> coefficient records (a parameter-sized table) as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def save_directions(df: DataFrame, path: str) -> None:
    """K5: per-layer direction + explained variance as Parquet."""
    df.select("layer", "direction", "evr").write.mode("overwrite").parquet(path)


def load_directions(spark: SparkSession, path: str, layers=None) -> DataFrame:
    """K5: read directions back; requested layers that are missing raise."""
    d = spark.read.parquet(path)
    if layers is not None:
        want = spark.createDataFrame([(int(x),) for x in layers], "layer int")
        missing = want.join(d.select("layer"), "layer", "left_anti").count()
        if missing:
            raise ValueError(f"{missing} requested layer(s) have no direction")
        d = d.join(F.broadcast(want), "layer")
    return d


def write_corpus(df: DataFrame, path: str) -> None:
    """K6: canonical corpus folders partitioned by (task, dataset)."""
    _writer(df, "overwrite", ("task", "dataset")).parquet(path)


def write_summary_csv(df: DataFrame, path: str) -> None:
    """K7: rollup tables to CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)
