"""Sinks: insert if absent, latest state, guarded state, day exports with a manifest, comparison with what was stored.

Plain Parquet has no merge. Facts are appended once per key; what changes is a log, and its present state a read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at a path, or an empty one of the same schema where none is."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], like.schema)


def insert_absent(new: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> int:
    """Appends rows whose key is not stored yet, one row a key (the smallest); returns how many.

    A repeat of the same rows, as after a lost batch, adds nothing. With ``partition_by``, columns that follow from the key, such as
    its day, only the stored partitions that the batch has rows of are read.
    """
    spark = new.sparkSession
    order = Window.partitionBy(*keys).orderBy(F.to_json(F.struct(*[c for c in new.columns])))
    once = new.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    old = stored(spark, path, new)
    if partition_by:
        old = old.join(new.select(*partition_by).distinct(), partition_by, "left_semi")
    fresh = once.join(old.select(*keys), keys, "left_anti").select(*new.columns).persist()
    try:
        count = fresh.count()
        if count:
            writer = fresh.write.mode("append")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return count
    finally:
        fresh.unpersist()


def latest_state(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key of a log."""
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def guarded_state(log: DataFrame, keys: list[str], settled: Column, order: list[Column]) -> DataFrame:
    """The same, but a key once settled stays with its first settled row."""
    rank = F.when(settled, 0).otherwise(1)
    first = F.when(settled, F.col("__place"))
    placed = log.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    chosen = Window.partitionBy(*keys).orderBy(rank, first.asc_nulls_last(), F.col("__place").desc())
    return placed.withColumn("__n", F.row_number().over(chosen)).where("__n = 1").drop("__n", "__place")


def write_days(lines: DataFrame, at: str, path: str, files: int = 8) -> None:
    """Records by the day of their own time, one folder a day of at most ``files`` files each."""
    salt = F.pmod(F.xxhash64(*lines.columns), F.lit(files))
    lines.withColumn("day", F.substring(at, 1, 10)).repartition("day", salt).write.mode("overwrite").partitionBy("day").parquet(path)


def manifest(lines: DataFrame, at: str, exported: str) -> DataFrame:
    """Per (file, day): lines, an order-free digest of them, and how many came later than the export they should be in.

    ``lines`` has file, raw and the time column ``at``; ``exported`` names the column with the day of export.
    """
    day = F.substring(at, 1, 10)
    marked = lines.withColumn("day", day).withColumn("late", day < F.col(exported))
    # sums of the four quarters of the lines' digests stand for all lines in any order; nothing is gathered
    quarters = [F.sum(F.conv(F.substring(F.sha2("raw", 256), 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    digest = F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[q.cast("string") for q in quarters]), 256)
    return marked.groupBy("file", "day").agg(F.count(F.lit(1)).alias("lines"), digest.alias("sha256"), F.count_if("late").alias("late"))


def reproduced(exported: DataFrame, stored_rows: DataFrame, key: str) -> DataFrame:
    """Export lines against the raw lines that the store kept: same, changed, lost (only exported) or new (only stored)."""
    left = exported.select(key, F.sha2("raw", 256).alias("exported"))
    right = stored_rows.select(key, F.sha2("raw", 256).alias("kept"))
    joined = left.join(right, key, "full_outer")
    state = F.when(F.col("kept").isNull(), "lost").when(F.col("exported").isNull(), "new").when(F.col("kept") == F.col("exported"), "same").otherwise("changed")
    return joined.withColumn("state", state)


def snapshot(frame: DataFrame, path: str) -> None:
    """An answer kept as JSON."""
    frame.coalesce(1).write.mode("overwrite").json(path)


def compact(spark: SparkSession, path: str, to: str, by: str, files: int = 1) -> None:
    """A table's partitions written again in few files each; the old files stay until the caller drops them."""
    rows = spark.read.parquet(path)
    rows.repartition(files, by).write.mode("overwrite").partitionBy(by).parquet(to)
