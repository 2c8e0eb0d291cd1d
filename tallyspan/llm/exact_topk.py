"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of the per-query lists.

Queries are dealt to blocks of ``QUERY_BLOCK``, candidates to shards of about ``SHARD_ROWS``; every block meets every
shard in one task, which multiplies tile by tile and keeps k rows a query. The lists of ``FAN_IN`` shards are
merged at a time until one list is left. Components are whole numbers, shuffled in as few bytes as the largest of the table needs.
Products are exact: in single precision while the largest possible sum stays under 2**24, in double precision under 2**53; rows
and queries with larger components are multiplied in limbs of 21 bits, whose sums are put together as whole numbers.

Defined results: vectors that are null or empty or hold a null or non-finite component, and rows without an id,
take no part; components and scores beyond 64 bits are the nearest 64-bit number, and rank as such; rows that share an id count once, with the smallest vector; vectors of another length are no
candidates; with fewer candidates than k all are returned; ties go to the smaller id; an empty table gives an empty
result; extra columns are not carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspan.llm.shared import table, written

QUERY_BLOCK = 32_768
SHARD_ROWS = 16_384
TILE_QUERIES, TILE_ROWS = 512, 8192
FAN_IN = 32


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, or null if the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))  # to the ends of a long, if beyond
    return F.when((F.size(vector) > 0) & F.coalesce(sound, F.lit(False)), scaled)


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


#: Bits of a limb, and components that are multiplied at a time so that sums of products stay under 2**53.
LIMB, LIMB_WIDTH = 21, 1024
LEAST, MOST = -(2**63), 2**63 - 1


def largest(rows: np.ndarray) -> np.ndarray:
    """The largest size of a component of each row; as floats, for the smallest long has no positive one."""
    return np.maximum(rows.max(1, initial=0).astype(np.float64), -(rows.min(1, initial=0).astype(np.float64)))


def wide(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of any 64-bit rows, exact, then cut to 64 bits."""

    def limbs(rows: np.ndarray) -> list[np.ndarray]:
        return [(rows >> LIMB * k & (1 << LIMB) - 1 if k < 2 else rows >> LIMB * 2).astype(np.float64) for k in range(3)]

    total = np.zeros((len(left), len(right)), object)
    for at in range(0, left.shape[1], LIMB_WIDTH):
        a, b = limbs(left[:, at : at + LIMB_WIDTH]), limbs(right[:, at : at + LIMB_WIDTH])
        for i in range(3):
            for j in range(3):
                total = total + (a[i] @ b[j].T).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return np.minimum(np.maximum(total, LEAST), MOST).astype(np.int64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, as numbers of a kind that holds them exactly."""
    a, b, dim = largest(left), largest(right), left.shape[1]
    bound = a.max(initial=0) * b.max(initial=0) * dim
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return left.astype(kind) @ right.astype(kind).T
    most = np.sqrt(2.0**53 / dim) * (1 - 1e-9)
    low, few = a < most, b < most  # a single large row does not slow down all others
    scores = np.empty((len(left), len(right)), np.int64)
    scores[np.ix_(low, few)] = left[low].astype(np.float64) @ right[few].astype(np.float64).T
    scores[:, ~few] = wide(left, right[~few])
    scores[np.ix_(~low, few)] = wide(left[~low], right[few])
    return scores


def best_of(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best rows of each query, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order].astype(np.int64), ids[order]
    queries = queries.astype(np.int64)
    found = []
    for a in range(0, len(queries), TILE_QUERIES):
        part = [[] for _ in query_ids[a : a + TILE_QUERIES]]
        for b in range(0, len(rows), TILE_ROWS):
            scores = products(queries[a : a + TILE_QUERIES], rows[b : b + TILE_ROWS])
            for i, line in enumerate(scores):
                own = query_ids[a + i]
                if len(line) > k + 1:
                    at = np.flatnonzero(line >= np.partition(line, len(line) - k - 1)[len(line) - k - 1])
                else:
                    at = np.arange(len(line))
                at = at[ids[b + at] != own]
                # ids ascend, so of equal scores the smaller id comes first if the reversed order is reversed again
                at = at[::-1][np.argsort(line[at[::-1]], kind="stable")[::-1]]
                part[i] += [(int(line[j]), int(ids[b + j])) for j in at[:k]]
        for i, seen in enumerate(part):
            found += [(int(query_ids[a + i]), y, s) for s, y in sorted(seen, key=lambda x: (-x[0], x[1]))[:k]]
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """One row per query and rank: query_id, rank (from 1), vec_id, score."""
    sound = vectors.select(F.col(id_column).cast("long").alias("vec_id"), whole_numbers(F.col(vector_column), scale).alias("v"), is_query.alias("q"))
    sound = sound.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    sound = written(sound.withColumn("dim", F.size("v")), "vectors")
    ends = [F.max(F.array_max("v")).alias("most"), F.min(F.array_min("v")).alias("least")]
    count = sound.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0)).alias("q"), *ends).first()
    bytes_of = {"smallint": 2**15, "int": 2**31}
    kind = next((t for t, n in bytes_of.items() if count["n"] and -n <= count["least"] and count["most"] < n), "bigint")
    sound = sound.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    blocks, shards = 1 + count["q"] // QUERY_BLOCK, 1 + count["n"] // SHARD_ROWS
    fixed = F.xxhash64("vec_id")
    # other names than the candidates' columns: a cogroup of one table with itself loses equally named ones
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("with_shard")
    queries = sound.where("q").select(F.col("dim").alias("of_dim"), F.pmod(fixed, F.lit(blocks)).cast("int").alias("of_block"), every, F.col("vec_id").alias("query_id"), F.col("v").alias("w"))
    rows = sound.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(fixed, F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            asked, given = matrix(left.column("w"), left.num_rows), matrix(right.column("v"), right.num_rows)
            found = best_of(asked, left.column("query_id").to_numpy(), given, right.column("vec_id").to_numpy(), k)
        columns = list(zip(*found, strict=True)) if found else [()] * 3
        shard = pa.array([key[2].as_py()] * len(found), pa.int32())
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), shard, pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["query_id", "shard", "vec_id", "score"])

    lists = queries.groupBy("of_dim", "of_block", "with_shard").cogroup(rows.groupBy("dim", "block", "shard")).applyInArrow(meet, "query_id long, shard int, vec_id long, score long")
    best = [F.col("score").desc(), F.col("vec_id")]
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(*best))).where(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
