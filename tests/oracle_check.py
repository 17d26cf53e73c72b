"""Compare a query's result with its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _cell(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def compare(df, db, sql: str) -> str | None:
    """None if columns, types and rows agree, else what differs."""
    relation = db.sql(sql)
    expected_types = dict(zip(relation.columns, map(str, relation.types)))
    actual_types = {name: TYPES.get(t, t) for name, t in df.dtypes}
    if expected_types != actual_types:
        return f"types: spark {actual_types}, sql {expected_types}"
    names = sorted(actual_types)
    expected = sorted(
        (tuple(_cell(v) for v in row) for row in db.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()), key=_key
    )
    actual = sorted((tuple(_cell(v) for v in row) for row in df.select(*names).collect()), key=_key)
    if len(expected) != len(actual):
        return f"rows: spark {len(actual)}, sql {len(expected)}"
    if not actual:
        return "no rows"
    for a, e in zip(actual, expected):
        if any(
            x != y and not (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            for x, y in zip(a, e)
        ):
            return f"first difference in {names}: spark {str(a)[:600]}, sql {str(e)[:600]}"
    return None
