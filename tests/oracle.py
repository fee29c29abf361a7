"""Runs a registered query and its comparison SQL side by side."""

from __future__ import annotations

import datetime
import glob
import math
import os
from decimal import Decimal

import duckdb

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT"}


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def differences(df, con, sql):
    """Problems as text lines; empty when types, row counts and values agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(set(names) ^ set(df.columns))}"]
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != kinds[name]:
            out.append(f"type of {name}: spark {kind}, sql {kinds[name]}")
    actual = df.collect()
    if len(actual) != len(expected):
        out.append(f"rows: spark {len(actual)}, sql {len(expected)}")
    if not actual:
        out.append("no rows")
    a, e = _rows(df.columns, actual), _rows(names, expected)
    wrong = [(x, y) for x, y in zip(a, e) if x != y]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {sorted(names)}\n  spark {wrong[0][0]}\n  sql   {wrong[0][1]}")
    return out
