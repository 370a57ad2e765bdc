"""Comparison of a query with its DuckDB SQL over the same parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("PAIRLOOM_DATA", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    """A value in a form that both engines' results compare in."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("0" if v == 0 else f"{v:.9g}")
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if hasattr(v, "is_integer") and v.is_integer():
        return str(int(v))
    return str(v)


def rows(names: list[str], values) -> list[str]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([plain(r[k]) for k in order]) for r in values)


def differences(query, sql: str, spark, sf_dir: str = DATA) -> str:
    """Empty if the query gives what the SQL gives; else what differs."""
    df = query(spark, sf_dir)
    ours, got = rows(df.columns, df.collect()), connect(sf_dir).execute(sql)
    names = [c[0] for c in got.description]
    theirs = rows(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        only = [sorted(set(x) - set(y))[:3] for x, y in ((ours, theirs), (theirs, ours))]
        return f"{len(ours)} and {len(theirs)} rows; only Spark: {only[0]}; only SQL: {only[1]}"[:3000]
    return ""
