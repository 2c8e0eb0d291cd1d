"""Joins that are not on equality: interval overlap, point in range, as-of, as-of through gaps.

Ranges are cut into buckets of fixed width and joined on the bucket, so Spark shuffles by key and no side need fit
in memory. As-of joins are a union and a running ``last``, one sort and no inequality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(lo: str, hi: str, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.least(lo, hi) / width), F.floor(F.greatest(lo, hi) / width)))


def overlapping(spans: DataFrame, ranges: DataFrame, key: str, keep: str | None = None, width: int = 64) -> DataFrame:
    """Keys of spans (key, lo, hi) that meet a range (lo, hi), ends included; with ``keep`` also that column of each range met.

    A span with lo = hi + 1 is the cut between two values and meets the ranges that hold both.
    """
    kept = [keep] if keep else []
    left = spans.where("lo <= hi + 1").select(key, "lo", "hi", _buckets("lo", "hi", width).alias("__b"))
    right = ranges.where("lo <= hi").select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), *kept, _buckets("lo", "hi", width).alias("__b"))
    met = left.join(right, "__b").where((F.col("lo") <= F.col("__hi")) & (F.col("hi") >= F.col("__lo")))
    return met.select(key, *kept).distinct()


def first_range(points: DataFrame, ranges: DataFrame, at: str, family: str, take: str) -> DataFrame:
    """Each point with ``take`` of the first range (by ``line``) of its family that holds it; null where none does.

    points: at, family. ranges: line, first, last, family, take; ``at``, first and last are whole numbers below 2^63 - 1.
    A line is one range of its family; of equal lines that hold a point the smallest ``take`` counts.

    Ranges are cut into aligned blocks of 2^level numbers, at most two a level, and every block keeps its first line only. A point
    looks into the one block of each level that it lies in, so the work is that of ranges and points times levels, not
    that of the pairs that meet.
    """
    held = ranges.where("first <= last").select("line", family, take, F.col("first").cast("long").alias("__first"), F.col("last").cast("long").alias("__last"))
    top = F.length(F.bin(F.col("__last") + 1 - F.col("__first"))) - 1  # no aligned block of a higher level fits in
    each = held.select("line", family, "__first", "__last", F.explode(F.sequence(F.lit(0), top)).alias("__level"))
    whole = each.withColumns({"__lo": F.expr("-shiftright(-__first, __level)"), "__hi": F.expr("shiftright(__last + 1, __level)")}).where("__lo < __hi")
    ends = F.explode(F.expr("filter(array(if(__lo % 2 <> 0, __lo, null), if(__hi % 2 <> 0, __hi - 1, null)), b -> b is not null)"))
    least = whole.select("line", family, "__level", ends.alias("__block")).groupBy(family, "__level", "__block").agg(F.min("line").alias("line"))
    spots = points.select(F.col(at).cast("long").alias("__at"), family).distinct()
    levels = F.sequence(F.lit(0), held.agg(F.max(top)).scalar())
    asked = spots.withColumn("__level", F.explode(levels)).withColumn("__block", F.expr("shiftright(__at, __level)"))
    lines = asked.join(_loosened(least, "__block"), [family, "__level", "__block"]).groupBy("__at", family).agg(F.min("line").alias("line"))
    inside = F.col("__at").between(F.col("__first"), F.col("__last"))
    best = lines.join(held, ["line", family]).where(inside).groupBy("__at", family).agg(F.min(take).alias(take))
    return points.withColumn("__at", F.col(at).cast("long")).join(_loosened(best, "__at"), ["__at", family], "left").drop("__at")


def _loosened(frame: DataFrame, key: str) -> DataFrame:
    """The same rows with a partitioning that Spark does not know, so that a join may split a hot key of its other side."""
    return frame.withColumn(key, F.bitwise_not(F.bitwise_not(key)))


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: Column, right_at: Column, take: list[str]) -> DataFrame:
    """Left rows with ``take`` of the newest right row of the same ``by`` at or before them (null where none is).

    ``*_at`` are orderable, comparable columns such as struct(height, tx_index); of equal right keys the largest
    values of ``take`` win.
    """
    names = left.columns
    carried = F.struct(*take)
    kind = right.select(carried.alias("t")).schema["t"].dataType
    one = left.withColumns({"__at": left_at, "__side": F.lit(1), "__take": F.lit(None).cast(kind), "__own": F.struct(*names)})
    two = right.select(*by, right_at.alias("__at"), F.lit(0).alias("__side"), carried.alias("__take"))
    both = one.select(*by, "__at", "__side", "__take", "__own").unionByName(two, allowMissingColumns=True)
    running = Window.partitionBy(*by).orderBy("__at", "__side", "__take").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__found", F.last("__take", ignorenulls=True).over(running)).where("__side = 1")
    return found.select("__own.*", *[F.col(f"__found.{t}").alias(t) for t in take])


def spans_of(history: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A history as spans: each row with the order key of its successor (``next_<key>``, null for the newest)."""
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)
    return history.withColumns({f"next_{k}": F.lead(k).over(window) for k in order})


def without_repeats(history: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """A history without rows whose values equal the ones in force."""
    window = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(F.struct(*values)).over(window)
    return history.withColumn("__before", before).where(~F.struct(*values).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")
