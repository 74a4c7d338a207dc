"""Deterministic, distributed sampling (survey SP1-SP7).

Random draws are replaced by the order ``md5(concat(id, ':', seed)), id``:
reproducible, identical in any SQL engine, and independent of partitioning.

Taking the first ``k`` rows of that order per group never uses a window over
a whole group (a hot class may hold a third of all rows).  ``rank_cut``
buckets rows by a prefix of the hash (hex prefixes sort like the hashes),
counts rows per (group, bucket) - a small table - and prefix-sums those
counts.  Buckets wholly past the cut are dropped before any window; the
remaining ones are ranked by windows over (group, bucket), whose size is
bounded by rows / 16^digits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protolens.operators.params import attach_params

TARGET_BUCKET_ROWS = 200_000


def _k(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def hash_order(id_col: str, seed: int | str | Column) -> Column:
    """md5(concat(id, ':', seed)) as lowercase hex."""
    if isinstance(seed, Column):
        s = seed.cast("string")
    elif isinstance(seed, str):
        s = F.col(seed).cast("string")
    else:
        s = F.lit(str(int(seed)))
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), s))


def rank_cut(df: DataFrame, keys, order: str, tie: str, k: int | str | None, rank_col: str = "rank",
             digits: int | None = None) -> DataFrame:
    """Rows whose 1-based rank within ``keys`` by (order, tie) is <= k, with their rank.

    ``order`` is a hex string column; ``k`` an int, a column name holding a
    per-row limit (constant within a group), or None for all rows.
    """
    keys = _k(keys)
    if digits is None:
        counts = df.groupBy(*keys).count() if keys else df.groupBy().count()
        largest = counts.agg(F.max("count")).first()[0] or 0
        digits = max(1, min(8, math.ceil(math.log(max(largest, 2) / TARGET_BUCKET_ROWS, 16)) if largest > TARGET_BUCKET_ROWS else 1))
    kcol = F.lit((1 << 63) - 1 if k is None else k) if k is None or isinstance(k, int) else F.col(k)
    b = df.withColumn("_bkt", F.substring(F.col(order), 1, digits)).withColumn("_k", kcol)
    sizes = b.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_bn"), F.max("_k").alias("_kmax"))
    wb = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1) if keys else \
        Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys, "_bkt", F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_before"), "_kmax")
    live = before.where(F.col("_before") < F.col("_kmax")).drop("_kmax")
    # (group, hash bucket) keys are uniform by construction: no salting needed above the broadcast limit
    kept = attach_params(b, live, keys + ["_bkt"], uniform_keys=True)
    w = Window.partitionBy(*keys, "_bkt").orderBy(F.col(order), F.col(tie))
    ranked = kept.withColumn(rank_col, F.col("_before") + F.row_number().over(w))
    if k is None:
        return ranked.drop("_bkt", "_before", "_k")
    return ranked.where(F.col(rank_col) <= F.col("_k")).drop("_bkt", "_before", "_k")


def sample_per_class(df: DataFrame, n: int, keys=(), label: str = "label", id_col: str = "example_id",
                     seed: int = 42, seed_col: str | None = None, rank_col: str | None = None,
                     strict: bool = False) -> DataFrame:
    """SP2/SP4/SP6: exactly ``n`` rows per (keys, label).

    Smaller classes keep all their rows, or raise with ``strict`` (sampling
    without replacement cannot draw more rows than a class has).
    """
    keys = _k(keys)
    if strict:
        small = df.groupBy(*keys, label).count().where(F.col("count") < n).limit(1).collect()
        if small:
            raise ValueError(f"class {small[0].asDict()} has fewer than {n} rows")
    h = hash_order(id_col, F.col(seed_col) if seed_col else seed)
    cut = rank_cut(df.withColumn("_h", h), keys + [label], "_h", id_col, n, rank_col or "_rank")
    cut = cut.drop("_h")
    return cut if rank_col else cut.drop("_rank")


def sample_fraction(df: DataFrame, frac: float, id_col: str = "example_id", seed: int = 42, keys=()) -> DataFrame:
    """SP1: exactly round(frac * n) rows (per group when ``keys`` given) in hash order."""
    keys = _k(keys)
    h = df.withColumn("_h", hash_order(id_col, seed))
    if keys:
        cnt = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        # round half to even, as Python round(frac * n)
        h = attach_params(h, cnt, keys).withColumn("_kk", F.bround(F.col("_n") * F.lit(frac), 0).cast("long"))
        return rank_cut(h, keys, "_h", id_col, "_kk", "_rank").drop("_h", "_n", "_kk", "_rank")
    total = h.count()
    k = int(round(frac * total))
    return rank_cut(h, [], "_h", id_col, k, "_rank").drop("_h", "_rank")


def shuffle_take(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """SP3: first ``n`` rows of the seeded order: hash buckets past the cut are dropped, no task merges full rows."""
    keyed = df.withColumn("_h", hash_order(id_col, seed))
    return rank_cut(keyed, [], "_h", id_col, n, "_rank").drop("_h", "_rank")


def paired_sample(left: DataFrame, right: DataFrame, key: str, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """SP5: draw ``n`` keys present on both sides, keep both sides' rows for them."""
    ids = left.select(key).distinct().join(right.select(key).distinct(), key)
    chosen = shuffle_take(ids, n, key, seed)
    return left.join(chosen, key, "left_semi"), right.join(chosen, key, "left_semi")


def seed_size_grid(df: DataFrame, seeds: Sequence[int], sizes: Sequence[int], keys=(), label: str = "label",
                   id_col: str = "example_id") -> DataFrame:
    """SP7: rows of every (seed, size) cell; ranks computed once per seed, cells nested by rank <= size."""
    keys = _k(keys)
    seeded = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    ranked = sample_per_class(seeded, max(sizes), keys + ["seed"], label, id_col, seed_col="seed", rank_col="rank")
    size_arr = F.array(*[F.lit(int(s)) for s in sizes])
    return ranked.withColumn("size", F.explode(F.filter(size_arr, lambda z: z >= F.col("rank"))))
