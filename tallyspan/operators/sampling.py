"""Sampled-out checks kept as decisions: expansion, collapse, and the audit of the draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expanded(decisions: DataFrame, points: DataFrame, assignments: DataFrame) -> DataFrame:
    """The rows that decisions stand for: NOT_PROBED for every point and every validator with rows."""
    return decisions.join(points, ["vantage", "promise_hash"]).join(assignments.where("row_count > 0").select("promise_hash", "validator"), "promise_hash").withColumn("cls", F.lit("NOT_PROBED"))


def with_expanded(stored: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The view of stored rows and expanded ones, as one table."""
    return stored.select(*columns).unionByName(rows.select(*columns))


def collapsible(rows: DataFrame) -> DataFrame:
    """(vantage, promise) whose not-probed rows are uniform: one reason, and every point holds the same validators."""
    points = rows.groupBy("vantage", "promise_hash", "scheduled_us").agg(F.array_sort(F.collect_set("validator")).alias("asked"), F.count(F.lit(1)).alias("n"), F.min("outcome").alias("o1"), F.max("outcome").alias("o2"), F.bool_and(F.col("cls") == "NOT_PROBED").alias("all_out"))
    found = points.groupBy("vantage", "promise_hash").agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("asked").alias("sets"), F.bool_and(F.col("n") == F.size("asked")).alias("single"), F.min("o1").alias("o1"), F.max("o2").alias("o2"), F.bool_and("all_out").alias("all_out"),
    )
    return found.where("sets = 1 and single and all_out and o1 = o2").select("vantage", "promise_hash", F.col("points").cast("long").alias("points"), F.col("o1").alias("reason"))


def draw(key: Column, secret: Column) -> Column:
    """64 bits of the hash of a key and the day's secret, as an exact number."""
    return F.conv(F.substring(F.sha2(F.concat(key, secret), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def audited(decisions: DataFrame, secrets: DataFrame) -> DataFrame:
    """Whether each draw agrees with its published share, and each revealed secret with its commitment.

    decisions: day, promise_hash, share (in 1/1000), probed. secrets: day, secret, commitment.
    """
    joined = decisions.join(secrets, "day")
    chosen = draw(F.col("promise_hash").cast("string"), F.col("secret")) * 1000 < F.lit("18446744073709551616").cast("decimal(20,0)") * F.col("share")
    return joined.select("day", "promise_hash", chosen.alias("chosen"), (chosen == F.col("probed")).alias("agrees"), (F.sha2("secret", 256) == F.col("commitment")).alias("secret_ok"))
