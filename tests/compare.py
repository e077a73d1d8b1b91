"""Runs a registered query on Spark and its SQL on DuckDB and compares all rows."""

from __future__ import annotations

import math
from datetime import datetime
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime):
        return value.isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(con, sql: str, df) -> str | None:
    """None when columns, row count and every value agree; otherwise what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = _rows(names, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but expected {sorted(names)}"
    if len(want) != len(got):
        return f"{len(got)} rows but expected {len(want)}: {[r for r in got if r not in set(want)][:2]} / {[r for r in want if r not in set(got)][:2]}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"row {str(g)[:300]} but expected {str(w)[:300]} in columns {sorted(names)}"
    return None
