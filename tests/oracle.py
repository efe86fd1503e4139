"""Compares a query with its SQL twin: names, row count, and values in any order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when both agree, else what differs."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    want_kinds = {c: _kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    got_kinds = {f.name: _kind(f.dataType.simpleString()) for f in df.schema}
    if want_kinds != got_kinds:
        return f"types {[(c, got_kinds[c], want_kinds[c]) for c in got_kinds if got_kinds[c] != want_kinds[c]]}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(rel.columns, rel.fetchall())
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows vs {len(want)}; only here {extra}; only there {missing}"


def _kind(name: str) -> str:
    name = name.lower()
    if name.startswith(("tinyint", "smallint", "int", "bigint", "hugeint", "uint", "ubigint")):
        return "whole"
    if name.startswith(("double", "float")):
        return "real"
    if name.startswith("decimal"):
        return "decimal"
    if name.startswith("timestamp"):
        return "time"
    if name.startswith(("varchar", "string")):
        return "text"
    return name
