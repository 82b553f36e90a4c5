"""Run a query and its checking SQL and compare names, types and values."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canon(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=sort_key)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both sides agree."""
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    sql_types = {d[0]: str(d[1]) for d in result.description}
    sql_rows = result.fetchall()
    rows = [tuple(r) for r in df.collect()]
    problems = []
    if sorted(df.columns) != sorted(sql_names):
        return [f"columns {sorted(df.columns)} != {sorted(sql_names)}"]
    for f in df.schema.fields:
        want = TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if want != sql_types[f.name]:
            problems.append(f"type of {f.name}: {want} != {sql_types[f.name]}")
    if len(rows) != len(sql_rows):
        problems.append(f"rows {len(rows)} != {len(sql_rows)}")
    _, a = table(df.columns, rows)
    names, b = table(sql_names, sql_rows)
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                problems.append(f"{names}\n  spark {str(x)[:600]}\n  sql   {str(y)[:600]}")
                break
        else:
            problems.append("values differ")
    return problems
