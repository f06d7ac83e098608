"""Run a query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        file = Path(sf_dir) / f"{name}.parquet"
        if file.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return (2, "nan")
        return (2, f"{float(value):.9g}")
    return (3, str(value))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    found = [c[0] for c in cursor.description]
    order = sorted(range(len(found)), key=lambda i: found[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()]
    return [found[i] for i in order], sorted(rows)


def difference(df, con, sql: str) -> str | None:
    """None if both sides hold the same rows, else the first difference."""
    names, mine = spark_rows(df)
    other_names, other = sql_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(mine) != len(other):
        return f"{len(mine)} rows != {len(other)} rows"
    for a, b in zip(mine, other, strict=True):
        if a != b:
            return f"{dict(zip(names, a))} != {dict(zip(names, b))}"
    return None
