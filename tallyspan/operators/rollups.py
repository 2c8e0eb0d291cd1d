"""Per-day partials: what can be summed over days is kept per day, windows are whole days plus raw edges.

Sums, maxima, sets and histograms merge over days. A maximum per pair over a window (attestation) does not, so it
stays with the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.operators.obligations import SUMS, sums
from tallyspan.plans.views import DAY


def day_of(at: Column) -> Column:
    return F.floor(at / DAY).cast("long")


def obligation_days(found: DataFrame) -> DataFrame:
    """The nine counts per (settlement day, validator)."""
    return sums(found.withColumn("day", day_of(F.col("settled_us"))), ["day", "validator"])


def class_days(checks: DataFrame) -> DataFrame:
    """Per (day, validator): checks, and the counts of classes as a map."""
    each = checks.groupBy(day_of(F.col("started_us")).alias("day"), "validator", "cls").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("day", "validator").agg(F.sum("n").alias("checks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("classes"))


def class_counts(checks: DataFrame, by: list[str]) -> DataFrame:
    """Counts of classes for a question that no kept day answers: one aggregate."""
    return checks.groupBy(*by, "cls").agg(F.count(F.lit(1)).alias("n"))


def merged_classes(days: DataFrame, by: list[str]) -> DataFrame:
    """Class counts summed over days by key of the map, so that equal maps of two days count twice."""
    return days.select(*by, F.explode("classes").alias("cls", "n")).groupBy(*by, "cls").agg(F.sum("n").alias("n"))


def merged_obligations(days: DataFrame, by: list[str], excluded: list | None = None) -> DataFrame:
    kept = days.where(~F.col("validator").isin(*excluded)) if excluded else days
    return kept.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def over_window(days: DataFrame, raw: DataFrame, start: int, end: int, by: list[str]) -> DataFrame:
    """Obligation sums of [start, end]: kept days that lie wholly inside, and raw obligations of the partial days at the ends."""
    first, last = -(-start // DAY), (end + 1) // DAY - 1  # whole days first..last
    inside = days.where(F.col("day").between(first, last))
    edges = raw.where(F.col("settled_us").between(start, end) & ~day_of(F.col("settled_us")).between(first, last))
    return merged_obligations(inside.unionByName(obligation_days(edges)), by)


def final_days(publications: DataFrame, held: DataFrame, waiting: DataFrame, now: int) -> DataFrame:
    """Every settlement day and whether it is final: windows closed, nothing held, no deferred verdict; and whether all days
    before are, which is how far a rollup in day order gets."""
    marked = publications.join(held.withColumn("held", F.lit(True)), "promise_hash", "left").join(waiting.select("promise_hash").distinct().withColumn("waits", F.lit(True)), "promise_hash", "left")
    days = marked.groupBy(day_of(F.col("settled_us")).alias("day")).agg(
        F.bool_and((F.col("must_serve_us") <= now) & F.col("held").isNull() & F.col("waits").isNull()).alias("final"), F.count(F.lit(1)).alias("promises")
    )
    order = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a day
    return days.withColumn("rolled", F.min(F.col("final").cast("int")).over(order) == 1)


def touched_days(new_rows: DataFrame, at: str) -> DataFrame:
    """Days that new rows make stale."""
    return new_rows.select(day_of(F.col(at)).alias("day")).distinct()


def refreshed(days: DataFrame, stale: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Kept days with the stale ones replaced."""
    return days.join(stale, "day", "left_anti").unionByName(recomputed)


def audit(kept: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows in which two computations of a table differ, either way."""
    return kept.exceptAll(recomputed).withColumn("side", F.lit("kept")).unionByName(recomputed.exceptAll(kept).withColumn("side", F.lit("recomputed")))


def read_plan(publications: DataFrame, checks: DataFrame, now: int, ahead: int, horizon: int) -> DataFrame:
    """Promises without an end reading: due (inside the last stretch before the deadline), missed (deadline past, inside the
    horizon), later or old; and finished ones."""
    done = checks.where(F.col("label").isin("end", "full", "enough") & (F.col("cls") != "NOT_PROBED")).select("promise_hash").distinct().withColumn("done", F.lit(True))
    left = F.col("must_serve_us") - now
    state = F.when(F.col("done"), "finished").when(left > ahead, "later").when(left > 0, "due").when(left > -horizon, "missed").otherwise("old")
    return publications.join(done, "promise_hash", "left").withColumn("state", state)
