"""Compare registered queries with their SQL on DuckDB: ``python tests/check.py SF [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "item"):
        return canon(v.item())
    return str(v)


def compare(df, con, sql: str) -> str | None:
    """None if both sides give the same rows, else what differs."""
    rel = con.sql(sql)
    cols = sorted(df.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} / {sorted(rel.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for n, t in df.dtypes:
        if names.get(t, t) != types[n]:
            return f"type of {n}: {t} / {types[n]}"
    mine = sorted(tuple(canon(r[c]) for c in cols) for r in df.select(*cols).collect())
    theirs = sorted(tuple(canon(v) for v in r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, e.g. {bad[0]} ({cols})" if bad else None


if __name__ == "__main__":
    from sparkmoor.plans.catalog import REGISTRY
    from sparkmoor.session import get_spark

    root = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = get_spark(f"local[{os.environ.get("CHECK_CPUS", "8")}]"), connect(root)
    failed = []
    for name in sys.argv[2:] or REGISTRY:
        q = REGISTRY[name]
        t0 = time.time()
        try:
            df = q.run(spark, root)
            note = compare(df, con, q.sql) if q.sql else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            note = f"{type(e).__name__}: {str(e)[:1500]}"
        ok = note is None or note.startswith("rows only")
        failed += [] if ok else [name]
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {time.time() - t0:6.2f}s {note or ''}", flush=True)
    print("failed:", failed)
