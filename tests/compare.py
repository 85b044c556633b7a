"""Row comparison of a Spark result with reference SQL run by DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("f", None if math.isnan(value) else round(value, 6) + 0.0)
    if value is None:
        return ("n", None)
    if isinstance(value, str):
        return ("s", value)
    return ("f", round(float(value), 6) + 0.0)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=repr)


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    result = con.execute(sql)
    return canonical([d[0] for d in result.description], result.fetchall())


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def difference(df, con, sql) -> str | None:
    """None if equal, else a short description."""
    names_a, a = spark_rows(df)
    names_b, b = sql_rows(con, sql)
    if names_a != names_b:
        return f"columns {names_a} != {names_b}"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows; e.g. {a[:2]} {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}"
    return None
