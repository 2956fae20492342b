"""Run registered queries in Spark and their SQL twins in DuckDB, and compare.

Mirrors the driver's check: same column names, same row count, and equal
multisets of rows (doubles compared after rounding to 6 places).

    python -m tests.oracle_check [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        f = float(v)
        if math.isnan(f):
            return None
        return round(f, 6) + 0.0
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        return tuple(_norm(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(oracle_pdf.columns)}"
    if len(spark_pdf) != len(oracle_pdf):
        return f"row count {len(spark_pdf)} vs {len(oracle_pdf)}"
    a, b = rows_of(spark_pdf), rows_of(oracle_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0]}"
    return None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv and not argv[0].isidentifier() else "/root/testdata/sf0.01"
    names = [x for x in argv if x.isidentifier()]
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from retainlab.session import get_spark

    spark = get_spark("local[8]", 8)
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    fails = 0
    for name in names or sorted(qs):
        t = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            fails += 1
            continue
        dt = time.time() - t
        if name not in sqls:
            print(f"rows {name}: {len(sp)} rows ({dt:.1f}s, no oracle)")
            continue
        try:
            orc = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:300]}")
            fails += 1
            continue
        msg = compare(sp, orc)
        if msg:
            fails += 1
            print(f"FAIL {name}: {msg}")
        else:
            print(f"ok   {name}: {len(sp)} rows ({dt:.1f}s)")
    print(f"{fails} failures")
    return 1 if fails else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
