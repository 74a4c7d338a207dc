"""Attaching parameter tables (means, matrices, thresholds) to example rows.

A parameter table is keyed by a few columns (layer, class, dataset...) and its
size is bounded by the model, not by the data: K x d means, d x d matrices.
It is materialized once (written below ``spark.checkpoint.dir``) and broadcast
only after its size has been measured against a limit.  Above the limit the
rows are salted and joined through a shuffle with the parameter table
replicated once per salt value, so no single task receives all example rows of
a hot key; keys that are uniform by construction (hash buckets, ranges) use a
plain shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
DEFAULT_SALT_BUCKETS = 64


def _cell_bytes(dt: T.DataType, col: Column, depth: int = 0) -> Column:
    """Rough serialized size of one value, as a Column expression."""
    if isinstance(dt, T.ArrayType):
        if depth > 2:
            return F.lit(64)
        inner = dt.elementType
        if isinstance(inner, (T.DoubleType, T.LongType)):
            return F.coalesce(F.size(col), F.lit(0)) * 8 + 16
        if isinstance(inner, (T.FloatType, T.IntegerType)):
            return F.coalesce(F.size(col), F.lit(0)) * 4 + 16
        return F.coalesce(
            F.aggregate(
                F.transform(col, lambda x: _cell_bytes(inner, x, depth + 1).cast("long")),
                F.lit(0).cast("long"),
                lambda a, b: a + b,
            ),
            F.lit(0),
        ) + 16
    if isinstance(dt, T.StructType):
        total = F.lit(8)
        for f in dt.fields:
            total = total + _cell_bytes(f.dataType, col[f.name], depth + 1)
        return total
    if isinstance(dt, T.StringType):
        return F.coalesce(F.length(col), F.lit(0)) + 16
    return F.lit(8)


def estimated_bytes(params: DataFrame) -> int:
    """Measure a parameter table: one cheap aggregate over a parameter-sized table."""
    expr = F.lit(0).cast("long")
    for f in params.schema.fields:
        expr = expr + _cell_bytes(f.dataType, F.col(f.name)).cast("long")
    # few partitions (a parameter table): one task, one job without a shuffle stage;
    # many partitions (a large bucket / range table): a parallel partial aggregate
    src = params.coalesce(1) if params.rdd.getNumPartitions() <= 8 else params
    row = src.agg(F.coalesce(F.sum(expr), F.lit(0)).alias("b")).first()
    return int(row["b"])


def materialize(df: DataFrame) -> DataFrame:
    """Compute a (parameter-sized or aggregated) table once and cut its lineage.

    The table is written as Parquet to a fresh folder below the shared
    ``spark.checkpoint.dir`` and read back (one job): later uses and task
    retries read the written table instead of re-running the lineage.
    """
    from protolens.session import scratch_path

    path = scratch_path(df.sparkSession, "mat")  # below the session's spark.checkpoint.dir
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # known schema: no inference job


def attach_params(
    rows: DataFrame,
    params: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_broadcast_bytes: int | None = None,
    salt_buckets: int = DEFAULT_SALT_BUCKETS,
    salt_col: str | None = None,
    materialized: bool = False,
    uniform_keys: bool = False,
) -> DataFrame:
    """Join ``params`` to ``rows`` on ``on``: broadcast when measured small, shuffle join otherwise.

    The parameter table is materialized first (unless ``materialized``), so
    measuring it and joining it run its lineage once.  Above the limit the
    join is salted (a hot key's rows spread over ``salt_buckets`` tasks), or,
    with ``uniform_keys`` (keys that are hash buckets or ranges by
    construction), a plain shuffle join.
    """
    on = list(on)
    spark = rows.sparkSession
    limit = max_broadcast_bytes
    if limit is None:
        limit = int(spark.conf.get("protolens.maxBroadcastBytes", str(DEFAULT_MAX_BROADCAST_BYTES)))
    if not materialized:
        params = materialize(params)
    size = estimated_bytes(params)
    if size <= limit:
        return rows.join(F.broadcast(params), on, how)
    if uniform_keys:
        return rows.join(params, on, how)
    # Salted shuffle join: spread each key's rows over ``salt_buckets`` tasks.
    if salt_col is not None:
        if salt_col in on:
            raise ValueError("salt_col must not be a join key: a hot key would stay in one task")
        salt = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salt_buckets)).cast("int")
    else:
        salt = row_salt(rows, on, F.lit(salt_buckets))
    salted_rows = rows.withColumn("_salt", salt)
    salted_params = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    return salted_rows.join(salted_params, on + ["_salt"], how).drop("_salt")


def row_salt(rows: DataFrame, keys: Sequence[str], buckets: Column) -> Column:
    """Salt in 0 .. buckets - 1 from the columns that are not keys (vectors too), the same on every retry."""
    other = [f.name for f in rows.schema.fields if f.name not in set(keys) and not isinstance(f.dataType, T.MapType)]
    if not other:
        raise ValueError("rows hold only key columns: there is nothing to salt by")
    return F.pmod(F.xxhash64(*[F.col(c) for c in other]), buckets).cast("int")


def require_dense_ids(packed: DataFrame, keys: Sequence[str], name: str) -> None:
    """Raise when a key's whole-number class ids are not 0 .. K - 1: scores are arrays by position, so a gap
    would shift every prediction after it.  One aggregate over a parameter table."""
    kind = packed.schema[name].dataType.elementType["_o"].dataType
    if not isinstance(kind, T.IntegralType):
        return
    ids = F.transform(name, lambda x: x["_o"])
    gap = packed.where((F.size(name) > 0) & ((F.array_min(ids) != 0) | (F.array_max(ids) != F.size(name) - 1)
                                             | (F.size(F.array_distinct(ids)) != F.size(name))))
    first = gap.select(*keys, ids.alias("ids")).limit(1).collect()
    if first:
        raise ValueError(f"class ids must be 0 .. K - 1 without gaps; found {first[0].asDict()}")


def pack_params(params: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], name: str) -> DataFrame:
    """Collapse per-class parameter rows into one sorted array of structs per key.

    Bounded by the number of classes/prototypes per key (parameter-sized).
    """
    keys = list(keys)
    return params.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(f) for f in fields]))).alias(name)
    )
