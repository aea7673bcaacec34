"""Run queries beside their SQL and compare rows: python tests/oracle_check.py [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).iterdir()):
        con.execute(f"create view {f.stem} as select * from '{f}{'/*' if f.is_dir() else ''}'")
    return con


def compare(df, con, sql: str) -> str:
    """'' if both give the same multiset of rows, else what differs."""
    cols = sorted(df.columns)
    rel = con.execute(sql)
    theirs_cols = [x[0] for x in rel.description]
    if sorted(theirs_cols) != cols:
        return f"columns {cols} against {sorted(theirs_cols)}"
    theirs = Counter(tuple(canon(r[theirs_cols.index(c)]) for c in cols) for r in rel.fetchall())
    ours = Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    if ours == theirs:
        return ""
    a, b = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{sum(ours.values())} rows against {sum(theirs.values())}; only ours {str(a)[:500]}; only SQL {str(b)[:500]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            said = compare(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__} {str(e)[:700]}"
        print(f"{'ok ' if not said else 'BAD' if name in sql or 'rows only' not in said else '-- '} {name} {time.time() - t:.1f}s {said}", flush=True)
