"""Pooling token vectors to one vector per example (survey V1-V3).

Input: token_vectors(example_id, [layer,] pos, mask, vector).  A sequence is
a bounded group (its token count), so per-example windows are safe; the
means are JVM ``Summarizer`` aggregates with a weight column.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool_last_token(df: DataFrame, keys=("example_id",), pos: str = "pos", mask: str = "mask",
                    vec: str = "vector") -> DataFrame:
    """V1: vector at the last position whose mask is 1 (Q21)."""
    keys = list(keys)
    return df.where(F.col(mask) == 1).groupBy(*keys).agg(F.max_by(vec, pos).alias(vec))


def pool_masked_mean(df: DataFrame, keys=("example_id",), mask: str = "mask", vec: str = "vector") -> DataFrame:
    """V2: sum(vector * mask) / sum(mask)."""
    keys = list(keys)
    return df.where(F.col(mask) != 0).groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)), F.col(mask).cast("double"))).alias(vec))


def pool_last_k_mean(df: DataFrame, k: int | str = 1, keys=("example_id",), pos: str = "pos", mask: str = "mask",
                     vec: str = "vector", suffix_len: str | None = None) -> DataFrame:
    """V3: mean of the last ``k`` valid positions; ``k='all'`` for every valid position,
    ``k='suffix'`` with a per-row ``suffix_len`` column."""
    keys = list(keys)
    valid = df.where(F.col(mask) == 1)
    if k == "all":
        return pool_masked_mean(valid, keys, mask, vec)
    w = Window.partitionBy(*keys).orderBy(F.col(pos).desc())
    ranked = valid.withColumn("_from_end", F.row_number().over(w))
    limit = F.col(suffix_len) if k == "suffix" else F.lit(int(k))
    last = ranked.where(F.col("_from_end") <= limit)
    return last.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias(vec))
