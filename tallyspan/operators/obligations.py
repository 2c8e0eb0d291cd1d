"""Obligations: one per promise and endorsing validator, from its counted checks; sums per validator and in all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions import rules

SUMS = ("total", "broken", "served", "end_unobserved", "held", "unobserved_reachable", "unobserved_unreachable", "unobserved_not_probed", "pending")


def population(counted: DataFrame, start: int | None, end: int) -> DataFrame:
    """Checks that speak for obligations of promises settled in [start, end], made by ``end``."""
    rows = counted.where((F.col("phase") == "in_window") & F.col("assigned") & F.col("attested"))
    rows = rows.where((F.col("settled_us") <= end) & (F.col("started_us") <= end))
    return rows if start is None else rows.where(F.col("settled_us") >= start)


def obligations(rows: DataFrame, now: int) -> DataFrame:
    """One row per (validator, promise): counts of its checks, class of the last one, whether pending, its bucket."""
    newest = Window.partitionBy("validator", "promise_hash").orderBy(F.col("cls").isin(*rules.GAPS), F.col("scheduled_us").desc(), F.col("started_us").desc(), "dedupe_key")
    end = rules.end_segment(F.col("scheduled_us"), F.col("settled_us"), F.col("must_serve_us"), F.col("label"))
    tried = ~F.col("counted").isin(*rules.GAPS)
    marked = rows.withColumn("__n", F.row_number().over(newest))
    out = marked.groupBy("validator", "promise_hash").agg(
        F.count_if(F.col("counted") == "FAULT").alias("faults"),
        F.count_if(F.col("counted") == "HEALTHY").alias("healthy"),
        F.count_if(F.col("counted") == "RETENTION_UNVERIFIED").alias("withheld"),
        F.count_if((F.col("counted") == "HEALTHY") & end).alias("late_healthy"),
        F.count_if(tried).alias("attempted"),
        F.count_if(tried & F.col("tls_ok")).alias("reached"),
        F.max(F.when(F.col("__n") == 1, F.col("counted"))).alias("last_cls"),
        F.bool_or(F.col("must_serve_us") > now).alias("pending"),
        F.min(F.when(F.col("counted") == "FAULT", F.col("started_us"))).alias("first_fault_us"),
        F.max("settled_us").alias("settled_us"),
    )
    bucket = (
        F.when(F.col("pending"), "pending")
        .when(F.col("faults") > 0, "broken")
        .when((F.col("last_cls") == "HEALTHY") & (F.col("late_healthy") > 0), "served")
        .when(F.col("healthy") > 0, "end_unobserved")
        .when(F.col("withheld") > 0, "held")
        .when(F.col("reached") > 0, "unobserved_reachable")
        .when(F.col("attempted") > 0, "unobserved_unreachable")
        .otherwise("unobserved_not_probed")
    )
    return out.withColumn("bucket", bucket)


def sums(found: DataFrame, by: list[str]) -> DataFrame:
    """The nine counts of obligations, per ``by``."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("bucket") == b).alias(b) for b in SUMS[1:]])


def provisional(found: DataFrame, now: int, settling: int) -> DataFrame:
    """Broken obligations, told apart by whether even the oldest fault is younger than ``settling``."""
    return found.where("bucket = 'broken'").withColumn("provisional", F.col("first_fault_us") > now - settling)


def rates(summed: DataFrame) -> DataFrame:
    """served / (served + broken) as numerator, denominator and value (null for none), with its 95 % bounds."""
    n = F.col("served") + F.col("broken")
    return summed.withColumns({
        "num": F.col("served"), "den": n, "rate": F.round(F.col("served") / F.nullif(n, F.lit(0)), 9),
        "rate_low": F.round(rules.wilson(F.col("served"), n, False), 6), "fault_high": F.round(rules.wilson(F.col("broken"), n, True), 6),
    })
