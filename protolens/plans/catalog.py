"""Registry of named queries: one per operator of the survey inventory.

Each entry is a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where the
operator has an SQL form, a DuckDB text over the driver tables that computes
the same rows (columns aliased identically, doubles rounded to 6 places).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

_MODULES = (
    "protolens.plans.q_vectors",
    "protolens.plans.q_metrics",
    "protolens.plans.q_meta",
    "protolens.plans.q_corpus",
    "protolens.plans.q_text",
    "protolens.plans.q_relational",
    "protolens.plans.q_sampling",
    "protolens.plans.q_contrast",
    "protolens.plans.q_rollup",
    "protolens.plans.q_io",
    "protolens.plans.q_flows",
    "protolens.plans.q_experiments",
)
_loaded = False


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    global _loaded
    if _loaded:
        return
    for m in _MODULES:
        importlib.import_module(m)
    _loaded = True


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
