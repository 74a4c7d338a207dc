"""Small shared plan pieces for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.sources import fixtures as fx
from protolens.sources.readers import select_layers


def rnd(c: Column | str, d: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def layer_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vector fixture without the embedding layer 0."""
    return select_layers(fx.vectors(spark, sf), exclude=(0,), pooling=None)


def train_test(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = layer_vectors(spark, sf)
    return v.where(F.col("split") == "train"), v.where(F.col("split") == "test")


def signal_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows whose label the vectors carry (for the stack)."""
    v = select_layers(fx.signal_vectors(spark, sf), exclude=(0,), pooling=None)
    return v.where(F.col("split") == "train"), v.where(F.col("split") == "test")


def long_array(df: DataFrame, keys, arr: str, idx: str = "i", val: str = "value", digits: int = 6) -> DataFrame:
    keys = list(keys)
    ex = df.select(*keys, F.posexplode(arr).alias(idx, val))
    return ex.select(*keys, F.col(idx).cast("int").alias(idx), rnd(val, digits).alias(val))


def long_matrix(df: DataFrame, keys, row: str = "row") -> DataFrame:
    """(keys..., i, row[]) -> (keys..., i, j, value)."""
    keys = list(keys)
    ex = df.select(*keys, "i", F.posexplode(row).alias("j", "value"))
    return ex.select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
                     rnd("value").alias("value"))
