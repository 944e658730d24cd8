"""Runs a registered query in Spark and its SQL in DuckDB, and compares rows with columns sorted by name."""

from __future__ import annotations

import datetime
import math
import os

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duckdb_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{p}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both agree."""
    df = query(spark, sf_dir)
    a_cols, a = df.columns, [tuple(r) for r in df.collect()]
    b_cols, b = duckdb_rows(sf_dir, sql)
    if sorted(a_cols) != sorted(b_cols):
        return f"columns {sorted(a_cols)} and {sorted(b_cols)}"
    a, b = normal(a_cols, a), normal(b_cols, b)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; first {a[:2]} and {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else ""
