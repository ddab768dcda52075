"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return float(repr(x))
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "FLOAT": "float", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "DATE": "date",
}


def differences(df, con, sql) -> list[str]:
    rel = con.sql(sql)
    names = rel.columns
    types = {n: KINDS.get(str(t), str(t)) for n, t in zip(names, rel.types)}
    want = _rows(names, rel.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} want {sorted(names)}"]
    for n, t in df.dtypes:
        if types[n] != t:
            out.append(f"type of {n}: {t} want {types[n]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} want {len(want)}")
    if got != want:
        extra = [r for r in got if r not in want][:3] if len(got) < 5000 else [g for g, w in zip(got, want) if g != w][:3]
        missing = [r for r in want if r not in got][:3] if len(got) < 5000 else [w for g, w in zip(got, want) if g != w][:3]
        out.append(f"values: got {extra} want {missing}")
    return out
