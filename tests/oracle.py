"""Compare queries with their SQL on DuckDB: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def difference(df, con, sql: str) -> str:
    """Empty if both give the same rows."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = rows_of([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if got[1] == want[1]:
        return ""
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return f"{len(got[1])} rows, {len(want[1])} in SQL; only here {sorted(a - b)[:2]}; only in SQL {sorted(b - a)[:2]}"


def main() -> None:
    import __spark_entry__ as entry

    from ironsieve.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = views(sys.argv[1]), entry.oracle_sql()
    for name in sys.argv[2:] or sql:
        began = time.time()
        try:
            what = difference(entry.queries()[name](spark, sys.argv[1]), con, sql[name]) if name in sql else f"{entry.queries()[name](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as e:
            what = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {what or 'same'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
