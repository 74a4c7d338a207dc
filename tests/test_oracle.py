"""Every registered query with an SQL form equals its DuckDB oracle at sf0.01;
every other query runs and returns rows; no query plan pairs all rows
(CartesianProduct / BroadcastNestedLoopJoin)."""

import pytest

from protolens.plans import catalog
from tools.oracle_check import check

from .conftest import SF_CHECK

QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()
STRICT = sorted(n for n in QUERIES if n in ORACLE)
ROWS_ONLY = sorted(n for n in QUERIES if n not in ORACLE)


@pytest.mark.parametrize("name", STRICT)
def test_matches_oracle(spark, duck, name):
    r = check(spark, duck, name, QUERIES[name], ORACLE[name], SF_CHECK, verbose=True)
    assert r["status"] == "ok", r  # rows, columns, value hash and column types


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, duck, name):
    r = check(spark, duck, name, QUERIES[name], None, SF_CHECK)
    assert r["status"] == "rows-only" and r["rows"] > 0, r


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert len(df.collect()) > 0
    assert set(df.columns) >= {"dataset", "method", "f1", "roc_auc"}
