"""Side-by-side comparison of a registered query with its SQL."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _key(row):
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_key)


# Types that must agree, by the name each engine gives them.
KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
}


def difference(df, con, sql: str) -> str | None:
    """None when both give the same columns, types and rows; else what differs."""
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    kinds = {d[0]: str(d[1]) for d in theirs.description}
    spark_names, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    duck_names, expected = rows_of(names, theirs.fetchall())
    if spark_names != duck_names:
        return f"columns {spark_names} against {duck_names}"
    wrong = {n: (k, kinds[n]) for n, k in df.dtypes if KINDS.get(k, k) != kinds[n]}
    if wrong:
        return f"types {wrong}"
    if len(ours) != len(expected):
        return f"{len(ours)} rows against {len(expected)}"
    for a, b in zip(ours, expected):
        if a != b:
            return f"{spark_names}\n  {a}\n  {b}"
    return None
