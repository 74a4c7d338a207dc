"""Run registered queries in Spark and their SQL oracles in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of values
(doubles rounded to 6 places).  Prints one line per query and a summary.
"""

from __future__ import annotations

import hashlib
import math
import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from protolens.sources.fixtures import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        r = round(v, 6)
        if r == 0:
            r = 0.0
        return repr(r)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


_SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT", "date": "DATE", "timestamp": "TIMESTAMP",
}


def type_mismatches(df, res) -> list:
    """Columns whose Spark type and DuckDB type differ (by name)."""
    duck = dict(zip(res.columns, [str(t) for t in res.types]))
    out = []
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        want = _SPARK_TO_DUCK.get(st, st.upper())
        got = duck.get(f.name)
        if got is not None and got != want:
            out.append((f.name, st, got))
    return out


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


FORBIDDEN_PLAN_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_violations(df, sf_dir: str | None = None) -> list:
    """Plan problems read from ``explain('formatted')``: nodes that pair all rows, and (with ``sf_dir``)
    a plan that scans neither the driver tables nor tables written from them (``/tables/`` scratch)."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    text = buf.getvalue()
    bad = [n for n in FORBIDDEN_PLAN_NODES if n in text]
    if sf_dir is not None and sf_dir.rstrip("/") + "/" not in text and "/tables/" not in text:
        bad.append("no scan of the given tables")
    return bad


def check(spark, con, name, fn, sql, sf_dir, verbose=False):
    t0 = time.time()
    df = fn(spark, sf_dir)
    bad_plan = plan_violations(df, sf_dir)
    if bad_plan:
        return dict(name=name, status="PLAN", plan=bad_plan)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if sql is None:
        return dict(name=name, status="rows-only", rows=len(srows), spark_s=round(t1 - t0, 2))
    res = con.sql(sql)
    dcols = res.columns
    drows = res.fetchall()
    t2 = time.time()
    ok_cols = sorted(scols) == sorted(dcols)
    hs, ls = _digest(scols, srows)
    hd, ld = _digest(dcols, drows)
    types = type_mismatches(df, res)
    status = "ok" if (ok_cols and len(srows) == len(drows) and hs == hd) else "MISMATCH"
    if status == "ok" and types:
        status = "TYPES"
    out = dict(name=name, status=status, rows=len(srows), duck_rows=len(drows), spark_s=round(t1 - t0, 2),
               duck_s=round(t2 - t1, 2))
    if types:
        out["types"] = types
    if status != "ok":
        out["cols"] = (sorted(scols), sorted(dcols))
        if verbose:
            diff_s = [x for x in ls if x not in set(ld)][:5]
            diff_d = [x for x in ld if x not in set(ls)][:5]
            out["only_spark"] = diff_s
            out["only_duck"] = diff_d
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from protolens.plans import catalog
    from protolens.session import local_session

    spark = local_session(8, "oracle-check")
    con = duck_connection(sf_dir)
    qs, sqls = catalog.queries(), catalog.oracle_sql()
    sel = names or sorted(qs)
    bad = 0
    for n in sel:
        try:
            r = check(spark, con, n, qs[n], sqls.get(n), sf_dir, verbose=bool(names))
        except Exception as e:  # report and continue
            r = dict(name=n, status="ERROR", error=f"{type(e).__name__}: {str(e)[:400]}")
            if names:
                traceback.print_exc()
        if r["status"] in ("MISMATCH", "ERROR", "TYPES", "PLAN"):
            bad += 1
        print(r, flush=True)
    print(f"SUMMARY {len(sel) - bad}/{len(sel)} ok-or-rows-only; {len([n for n in sel if n in sqls])} with oracle")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
