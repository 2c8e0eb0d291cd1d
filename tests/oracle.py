"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path
from typing import Any

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = "/root/testdata/sf0.001"


def plain(value: Any) -> Any:
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("<NA>", "NaT"):
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
        return bool(value)
    if hasattr(value, "item"):
        value = value.item()
    return int(value) if isinstance(value, float) and value.is_integer() else value


def connected(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if Path(folder, f"{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def rows(frame, columns: list[str]) -> list[str]:
    return sorted(repr(tuple(map(plain, row))) for row in frame[columns].itertuples(index=False, name=None))


def same(spark, build, sql: str, folder: str = FOLDER) -> int:
    """Asserts equal columns and rows; returns how many rows there are."""
    ours, theirs = build(spark, folder).toPandas(), connected(folder).execute(sql).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = rows(ours, columns), rows(theirs, columns)
    assert len(a) == len(b), (len(a), len(b))
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not different, different[:3]
    return len(a)
