"""Passes over new records: a fixed order of inserts, records that wait for others, deferred verdicts, day refresh.

Nothing is dropped for being late: a record whose dependency is missing waits in a table, a verdict waits for the
scanner's frontier, and a day touched by new rows is computed again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.operators.rollups import day_of
from tallyspan.sources.sinks import insert_absent, stored

#: Order of inserts within a pass: what others refer to comes first.
ORDER = ("publications", "param_uncertainty", "corrections", "measurements", "reachability", "payments", "host_history", "amendments")


def ready(waiting: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records whose dependency is known, and those that go on waiting."""
    keys = known.select(key).distinct()
    return waiting.join(keys, key, "left_semi"), waiting.join(keys, key, "left_anti")


def due(waiting: DataFrame, frontier: int, timeout: int) -> DataFrame:
    """Deferred checks that the frontier has passed."""
    return waiting.where(F.col("started_us") + timeout <= frontier)


class Versions:
    """A small table that is replaced as a whole: the highest version counts, older ones go once it is written."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that were written to their end."""
        if not self.files.exists(self.folder):
            return []
        found = [status.getPath() for status in self.files.listStatus(self.folder)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(path.getName()) for path in found if path.getName().isdigit() and self.files.exists(done(path, "_SUCCESS")))

    def path(self, version: int) -> str:
        return f"{self.folder.toString()}/{version}"

    def read(self, like: DataFrame) -> DataFrame:
        known = self.versions()
        return stored(self.spark, self.path(known[-1]), like) if known else self.spark.createDataFrame([], like.schema)

    def replace(self, rows: DataFrame) -> None:
        known = self.versions()
        rows.write.mode("overwrite").parquet(self.path(known[-1] + 1 if known else 0))
        for old in known:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(old)), True)


@dataclass
class Collector:
    """Keeps tables under a folder up to date with batches of records, each as one ``foreachBatch`` function."""

    spark: SparkSession
    folder: str
    keys: dict[str, list[str]]
    needs: dict[str, tuple[str, str]] = field(default_factory=dict)  # kind -> (kind it depends on, key)

    def path(self, kind: str) -> str:
        return f"{self.folder}/{kind}"

    def table(self, kind: str, like: DataFrame) -> DataFrame:
        return stored(self.spark, self.path(kind), like)

    def take(self, kind: str, batch: DataFrame) -> int:
        """Inserts a batch; records without their dependency are kept aside and tried again with the next batch."""
        if kind not in self.needs:
            return insert_absent(batch, self.path(kind), self.keys[kind])
        other, key = self.needs[kind]
        aside = Versions(self.spark, self.path(f"{kind}_waiting"))
        known = stored(self.spark, self.path(other), batch.select(key))
        now, later = ready(batch.unionByName(aside.read(batch)), known, key)
        count = insert_absent(now, self.path(kind), self.keys[kind])
        aside.replace(later.dropDuplicates(self.keys[kind]))
        return count

    def waiting(self, kind: str, like: DataFrame) -> DataFrame:
        """Records that go on waiting."""
        return Versions(self.spark, self.path(f"{kind}_waiting")).read(like)

    def run_pass(self, batches: dict[str, DataFrame]) -> dict[str, int]:
        """One pass over a batch of each kind, in the fixed order; returns what each added."""
        return {kind: self.take(kind, batches[kind]) for kind in ORDER if kind in batches and kind in self.keys}

    def sink(self, kind: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: a repeated batch changes nothing, so each record counts once."""
        return lambda batch, _: (self.take(kind, batch), None)[1]


def refresh_days(spark: SparkSession, new_rows: DataFrame, at: str, recompute: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Recomputes the days that new rows touch and overwrites just their partitions."""
    stale = new_rows.select(day_of(F.col(at)).alias("day")).distinct()
    again = recompute(stale)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def newest_event(batch: DataFrame, at: str) -> DataFrame:
    """The newest row of a batch: what a live display shows."""
    return batch.orderBy(F.desc(at)).limit(1)


def hourly_counts(beats: DataFrame, at: str, delay: str = "1 hour") -> DataFrame:
    """A streaming count of beats per validator and hour; an hour is given out once the watermark has passed it."""
    timed = beats.withColumn("at", F.timestamp_micros(at)).withWatermark("at", delay)
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "validator").agg(F.count(F.lit(1)).alias("beats"), F.count_if("up").alias("up")).select("w.start", "validator", "beats", "up")
