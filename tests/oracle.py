"""Compare a Spark result with a DuckDB oracle over the same parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            return v
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0) for x in row)


def compare(spark_df, con, sql: str):
    """Return (ok, message). Columns are matched by name; rows order-insensitively."""
    s_cols = spark_df.columns
    s_rows = [tuple(_norm(r[c]) for c in sorted(s_cols)) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_raw = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    idx = [d_cols.index(c) for c in sorted(s_cols)]
    d_rows = [tuple(_norm(r[i]) for i in idx) for r in d_raw]
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    s_sorted = sorted(s_rows, key=_key)
    d_sorted = sorted(d_rows, key=_key)
    bad = 0
    first = None
    for a, b in zip(s_sorted, d_sorted):
        if not _rows_close(a, b):
            bad += 1
            if first is None:
                first = (a, b)
    if bad:
        return False, f"{bad} rows differ; first spark={first[0]} duck={first[1]} cols={sorted(s_cols)}"
    return True, f"{len(s_rows)} rows equal"


def _rows_close(a, b):
    for x, y in zip(a, b):
        if isinstance(x, float) and isinstance(y, float):
            if abs(x - y) > 1e-6 * max(1.0, abs(x), abs(y)):
                return False
        elif isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and not isinstance(y, bool):
            if abs(float(x) - float(y)) > 1e-6 * max(1.0, abs(float(x))):
                return False
        elif x != y:
            return False
    return True
