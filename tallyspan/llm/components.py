"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a join and an aggregate of the edges; nothing of the graph reaches the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.shared import drop_written, loosened, written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a", "a")).alias("y")).first()
    return (row["n"], row["x"], row["y"])


def _step(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(loosened(F.col("a")).alias("a"), F.least("a", "m").alias("m"))
    large = both.join(lowest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    root = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(root.select(loosened(F.col("a")).alias("a"), "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return small.unionByName(root.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node it can reach.

    Loops and repeated edges are allowed; null ends must be gone. An empty edge table gives no rows.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(start, f"{tag}-edges")
    mark = _mark(now)
    while mark[0]:
        after = written(_step(now), f"{tag}-edges")
        changed = _mark(after)
        drop_written(now)
        now = after
        if changed == mark:
            break
        mark = changed
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots).distinct()
