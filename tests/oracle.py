"""Runs a registered query and its oracle SQL and compares rows, names and types."""

from __future__ import annotations

import math

import duckdb

from plumbline.sources.tables import TABLES

# DuckDB type -> type names Spark may use for the same column.
TYPES = {
    "BIGINT": {"bigint"},
    "INTEGER": {"int"},
    "DOUBLE": {"double"},
    "VARCHAR": {"string"},
    "BOOLEAN": {"boolean"},
    "DATE": {"date"},
    "TIMESTAMP": {"timestamp_ntz", "timestamp"},
}


def run_oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    return names, types, cursor.fetchall()


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def differences(df, sf_dir: str, sql: str) -> list[str]:
    """Empty when both sides agree."""
    names, types, expected = run_oracle(sf_dir, sql)
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for column, kind in df.dtypes:
        if kind not in TYPES.get(types[column], {types[column]}):
            found.append(f"type of {column}: {kind} != {types[column]}")
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    want = _rows(names, expected)
    if len(got) != len(want):
        found.append(f"{len(got)} rows != {len(want)}")
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        found.append(f"spark only {only_got}\noracle only {only_want}")
    return found
