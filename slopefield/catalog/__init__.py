"""Every operator as a query over the given tables, with an equivalent SQL text.

The SQL is written for a second engine and shares no code with the queries.
"""

from slopefield.catalog import cleaning, reports, scans, training

_PARTS = (training, scans, cleaning, reports)


def all_queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
