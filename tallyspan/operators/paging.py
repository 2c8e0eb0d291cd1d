"""Filters from optional arguments, sorts, top-k, and pages by key."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(rows: DataFrame, equal: dict[str, Any] | None = None, among: dict[str, list] | None = None, prefix: dict[str, str] | None = None, folded: dict[str, str] | None = None, since: dict[str, Any] | None = None, until: dict[str, Any] | None = None) -> DataFrame:
    """Rows that meet every condition given: equal, among a list, by prefix, equal without case, from, up to."""
    for column, value in (equal or {}).items():
        rows = rows.where(F.col(column) == value)
    for column, values in (among or {}).items():
        rows = rows.where(F.col(column).isin(*values)) if values else rows.limit(0)
    for column, value in (prefix or {}).items():
        rows = rows.where(F.col(column).startswith(value))
    for column, value in (folded or {}).items():
        rows = rows.where(F.upper(column) == value.upper())
    for column, value in (since or {}).items():
        rows = rows.where(F.col(column) >= value)
    for column, value in (until or {}).items():
        rows = rows.where(F.col(column) <= value)
    return rows


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.orderBy(*[F.desc(k) for k in keys])


def before(rows: DataFrame, keys: list[str], cursor: tuple, limit: int) -> DataFrame:
    """The page after a cursor, newest first, with one row more than asked for: its presence says there is another page."""
    here = F.struct(*[F.col(k).cast("long").alias(k) for k in keys])
    there = F.struct(*[F.lit(c).cast("long").alias(k) for k, c in zip(keys, cursor, strict=True)])
    return newest(rows.where(here < there), keys).limit(limit + 1)


def at_most(rows: DataFrame, limit: int) -> DataFrame:
    """How many rows there are, counting no further than a limit."""
    return rows.select(F.lit(1).alias("one")).limit(limit).agg(F.count("one").alias("n"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place in a whole order; for dimension tables."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))
