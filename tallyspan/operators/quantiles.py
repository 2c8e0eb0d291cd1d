"""Exact quantiles: by rank over rows, and by cumulated counts over mergeable histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(n: Column, percent: int) -> Column:
    """The 1-based rank of a percentile among n values: percent * n / 100, rounded up."""
    return F.floor((n * percent + 99) / 100).cast("long")


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Counts of values, per ``by``: sums of such tables over parts are the table of the whole."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def merged(parts: DataFrame, by: list[str], value: str) -> DataFrame:
    return parts.groupBy(*by, value).agg(F.sum("n").alias("n"))


def from_histogram(counts: DataFrame, by: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """Nearest-rank percentiles from a histogram: the first value whose cumulated count reaches the rank.

    The sort is over distinct values of a group, not over rows.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.withColumn("__upto", F.sum("n").over(upto)).withColumn("__all", F.sum("n").over(group))
    picks = [F.min(F.when(F.col("__upto") >= nearest_rank(F.col("__all"), p), F.col(value))).alias(name) for name, p in percents.items()]
    return summed.groupBy(*by).agg(F.sum("n").alias("n"), *picks)


def from_rows(rows: DataFrame, by: list[str], value: str, tie: list[str], percents: dict[str, int]) -> DataFrame:
    """The same by row number; for small groups."""
    group = Window.partitionBy(*by)
    ranked = rows.where(F.col(value).isNotNull()).withColumn("__k", F.row_number().over(group.orderBy(value, *tie))).withColumn("__all", F.count(F.lit(1)).over(group))
    picks = [F.max(F.when(F.col("__k") == nearest_rank(F.col("__all"), p), F.col(value))).alias(name) for name, p in percents.items()]
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *picks)


def octave_bucket(value: Column, parts: int = 64) -> Column:
    """Bucket of a positive value on a scale of ``parts`` steps an octave: order-preserving, for a first, coarse pass."""
    octave = F.floor(F.log2(value.cast("double"))).cast("long")
    base = F.pow(F.lit(2.0), octave).cast("long")
    return F.when(value < 1, F.lit(0).cast("long")).otherwise(1 + octave * parts + F.floor((value - base) * parts / base).cast("long"))


def two_pass(counts: DataFrame, value: str, percent: int) -> DataFrame:
    """One percentile of a large histogram: a pass over coarse buckets finds the one, a second looks inside it."""
    coarse = counts.withColumn("__b", octave_bucket(F.col(value))).groupBy("__b").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = coarse.withColumn("__upto", F.sum("n").over(upto)).withColumn("__all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    hit = marked.where((F.col("__upto") >= nearest_rank(F.col("__all"), percent)) & (F.col("__upto") - F.col("n") < nearest_rank(F.col("__all"), percent)))
    found = hit.select("__b", (nearest_rank(F.col("__all"), percent) - F.col("__upto") + F.col("n")).alias("__rank"))
    inner = counts.withColumn("__b", octave_bucket(F.col(value))).join(found, "__b")
    running = Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return inner.withColumn("__upto", F.sum("n").over(running)).where("__upto >= __rank").agg(F.min(value).alias(value))


def lower_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The lower of the two middle values of an even number."""
    return from_histogram(histogram(rows, by, value), by, value, {value: 50}).select(*by, "n", value)
