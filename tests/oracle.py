"""Run a registered query on Spark and its SQL on DuckDB, and compare rows exactly."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: [(v is None, str(v)) for v in r])


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return _rows([d[0] for d in cur.description], cur.fetchall())


SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df, con, sql):
    mine = {c: SPARK_TYPES.get(t, t) for c, t in df.dtypes}
    other = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    return {c: (mine.get(c), other.get(c)) for c in {*mine, *other} if mine.get(c) != other.get(c)}


def differences(left, right, limit=3):
    """Empty when equal; else what differs, briefly."""
    (lc, lr), (rc, rr) = left, right
    if lc != rc:
        return [f"columns differ: only left {sorted(set(lc) - set(rc))}, only right {sorted(set(rc) - set(lc))}"]
    if len(lr) != len(rr):
        return [f"{len(lr)} rows against {len(rr)}"]
    out = []
    for a, b in zip(lr, rr):
        if a != b:
            out.append({c: (x, y) for c, x, y in zip(lc, a, b) if x != y})
            if len(out) == limit:
                break
    return out
