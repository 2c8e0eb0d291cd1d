"""Helpers of the training-data operators: table reading, written intermediate tables, small expression tools."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract of this subpackage: blank and \\x09 to \\x0D.
GAPS = " \t\n\x0b\x0c\r"

_test_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read through Spark alone so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor can read.

    Where it is unset a temporary folder stands in, but in local mode only: elsewhere executors
    could not read each other's files, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _test_folders:
        _test_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tallyspan-")
    return _test_folders[context.applicationId]


def own_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_folder(spark)}/tallyspan/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results that were not written yet are lost with them."""
    _delete(spark, own_folder(spark))


#: Folders of the tables written inside the open scopes, innermost last.
_scopes: list[list[str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(frame: DataFrame, tag: str, partitions: int | None = None, keep: bool = False, codec: str | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors.

    The open scope drops it when it ends, unless it is to be kept.
    """
    spark = frame.sparkSession
    path = f"{own_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    (frame.coalesce(partitions) if partitions else frame).write.parquet(path, compression=codec)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables that are written inside, when it ends; gives the function that writes a result to be kept.

    A result that is not written inside by that function may read tables that are gone afterwards.
    """
    mine: list[str] = []
    _scopes.append(mine)

    def kept(frame: DataFrame, tag: str) -> DataFrame:
        result = written(frame, tag)
        path = mine.pop()
        if len(_scopes) > 1:  # it is the outer scope's now
            _scopes[-2].append(path)
        return result

    try:
        yield kept
    finally:
        _scopes.remove(mine)
        for path in mine:
            _delete(spark, path)


def drop_written(frame: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    spark = frame.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in frame.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/tallyspan/" in str(folder):
            folder.getFileSystem(conf).delete(folder, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def loosened(key: Column) -> Column:
    """The same whole numbers, as an expression whose partitioning Spark does not know.

    A table that was aggregated by a key is partitioned by it, and a join on that key would reuse this: one task then
    has all rows of a hot key on the other side. Joined on the loosened key both sides are shuffled for the join alone,
    and adaptive execution may split a hot partition.
    """
    return F.bitwise_not(F.bitwise_not(key))


def words(text: Column) -> Column:
    """Words of a text, in order; null text gives none. One-character gaps split without a regular expression."""
    text = F.coalesce(text, F.lit(""))
    for gap in GAPS[1:]:
        text = F.replace(text, F.lit(gap), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def sampled_ids(documents: DataFrame, rows: int, id_column: str, text_column: str) -> DataFrame:
    """(__id, __text) of at most ``rows`` ids, those whose hashes come first; one text an id (its smallest)."""
    source = documents.select(F.col(id_column).alias("__id"), F.coalesce(F.col(text_column), F.lit("")).alias("__text"))
    picked = source.select("__id").where("__id is not null").distinct().orderBy(F.xxhash64("__id"), "__id").limit(rows)
    known = documents.sparkSession.createDataFrame(picked.collect(), source.select("__id").schema)  # rows ids at most
    return source.join(F.broadcast(known), "__id").groupBy("__id").agg(F.min("__text").alias("__text"))
