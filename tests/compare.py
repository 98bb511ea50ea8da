"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if value is None:
        return "∅"
    if isinstance(value, float | decimal.Decimal):
        return f"{float(value):.5g}"
    if isinstance(value, list | tuple):
        return str([plain(x) for x in value])
    if isinstance(value, dict):
        return str(sorted((k, plain(v)) for k, v in value.items()))
    return str(value)


def family(kind: str) -> str:
    kind = kind.lower()
    for name, forms in {"int": ("int", "long", "hugeint"), "float": ("double", "float", "decimal", "real"), "str": ("varchar", "string"), "time": ("timestamp",), "bool": ("bool",), "date": ("date",)}.items():
        if any(f in kind for f in forms):
            return name
    return kind


def differences(df, con, sql: str) -> str:
    """Empty if columns, type families and rows agree, order aside."""
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    kinds = {c[0]: family(str(c[1])) for c in answer.description}
    own = {f.name: family(f.dataType.simpleString()) for f in df.schema}
    if any(kinds[c] != own[c] and not own[c].startswith(("array", "map", "struct")) for c in columns):
        return f"types {own} against {kinds}"
    at = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in at) for r in answer.fetchall())
    if got == expected:
        return ""
    a, b = set(got), set(expected)
    return f"{len(got)} rows against {len(expected)}; only here {sorted(a - b)[:3]}, only there {sorted(b - a)[:3]}"
