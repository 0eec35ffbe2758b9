"""Run a query in Spark and its SQL in DuckDB and compare them as bags of rows."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime()
    return v


def bags(spark_df, con, sql: str):
    cols = sorted(spark_df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in spark_df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in cols] if sorted(names) == cols else None
    if order is None:
        raise AssertionError(f"columns differ: spark {cols}, sql {sorted(names)}")
    want = Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    return got, want
