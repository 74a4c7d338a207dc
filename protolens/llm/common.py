"""Shared steps of the operators: reading, written tables, small helpers."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protolens.session import ensure_checkpoint_dir, scratch_path, ship_package


def prepare(spark: SparkSession) -> None:
    """Package on the executors and a known shared folder (both idempotent)."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write below the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of a documents table; other columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hot_join(rows: DataFrame, other: DataFrame, on: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """Left join to a table with one row for every key of ``rows``, whose column ``weight`` counts the rows that have it.

    Keys with more than 1/``share`` of the ``total`` rows are fewer than ``share``: they are broadcast, so that no task
    receives the rows of a hot key.  The others meet in a shuffle.
    """
    bar = max(1, total // share)
    hot = F.broadcast(other.where(F.col(weight) > bar))
    rest = rows.join(F.broadcast(other.where(F.col(weight) > bar).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(other.where(F.col(weight) <= bar), on, "left"))
