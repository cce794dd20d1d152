"""Compare a Spark result with its DuckDB twin: columns, types, row count and values in any order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Spark type -> DuckDB types that count as the same.
SAME_TYPE = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "float": {"FLOAT"},
}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _key(row):
    return [(x is not None, str(type(x)), x) if not isinstance(x, float) else (True, "num", x) for x in row]


def differences(df, con, sql: str) -> list[str]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for name, kind in df.dtypes:
        if types[name] not in SAME_TYPE.get(kind, {types[name]}):
            out.append(f"type of {name}: {kind} against {types[name]}")
    order = sorted(names)
    mine = [tuple(_plain(r[c]) for c in order) for r in df.collect()]
    at = [names.index(c) for c in order]
    theirs = [tuple(_plain(r[i]) for i in at) for r in rows]
    if len(mine) != len(theirs):
        return [*out, f"rows {len(mine)} against {len(theirs)}"]
    mine.sort(key=_key)
    theirs.sort(key=_key)
    bad = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    if bad:
        out.append(f"{len(bad)} of {len(mine)} rows differ, e.g. {str(bad[0])[:600]}")
    return out
