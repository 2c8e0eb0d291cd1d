"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A key draws ``-ln(u) / weight`` for every shard, u being a hash of key and shard. A rack's draw is the least of its
shards' draws, a region's the least of its racks'; the least of independent exponential draws is itself a draw with
the summed weight, so at each level a node is met in proportion to the weight below it. The descent takes the
least draw at each level. Adding a shard, or raising its weight, lowers draws in its own subtree only: rows move
into that shard and nowhere else.

Slots are ranks within a shard, counted inside 4096 hash groups of ids and shifted by the groups before. Equal rows, however
many, are told apart by a salt of ``SALTS`` values: a group only orders the counts of its distinct rows, so neither a shard
nor the rows of one id are sorted in one task.

Defined results: a null text has size 8 and the checksum of no bytes; a null id is the key of the empty string;
rows of one id share a shard and have a slot each; an empty table gives an empty result; extra columns are not
carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspan.llm.shared import let, table, written

SHARDS = 24
GROUP_DIGITS = 3  # hexadecimal digits that name a slot group
SALTS = 256


@dataclass(frozen=True)
class Shard:
    number: int
    rack: int
    region: int
    weight: float = 1.0


def layout(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Equal shards filled rack by rack and region by region."""
    return [Shard(n, n // per_rack, n // per_rack // racks_per_region) for n in range(shards)]


def draw(key: Column, shard: Shard) -> Column:
    """Exponential draw of a key for a shard, from 52 bits of a hash; rate is the shard's weight."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard.number}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(shard.weight)


def descend(key: Column, tree: list[Shard]) -> Column:
    """The shard a key falls to: region, then rack, then shard, by the least draw at each level."""

    def by(level: str, shards: list[Shard]) -> dict[int, list[Shard]]:
        found: dict[int, list[Shard]] = {}
        for s in shards:
            found.setdefault(getattr(s, level), []).append(s)
        return found

    def pick(draws: Column, shards: list[Shard], levels: tuple[str, ...]) -> Column:
        if not levels:
            return F.lit(shards[0].number)
        nodes = [*by(levels[0], shards).values()]
        if len(nodes) == 1:
            return pick(draws, nodes[0], levels[1:])
        at = {s.number: k for k, s in enumerate(tree)}
        least = [F.array_min(F.array(*[F.get(draws, F.lit(at[s.number])) for s in node])) for node in nodes]
        first = pick(draws, nodes[-1], levels[1:])
        for k in range(len(nodes) - 2, -1, -1):
            first = F.when(least[k] <= (F.least(*least[k + 1 :]) if len(least) > k + 2 else least[k + 1]), pick(draws, nodes[k], levels[1:])).otherwise(first)
        return first

    return let(F.array(*[draw(key, s) for s in tree]), lambda draws: pick(draws, tree, ("region", "rack", "number")))


def shard(documents: DataFrame, tree: list[Shard], grown: list[Shard], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: doc_id, size, text_crc32, law, shard, slot and grown_shard (the shard in the grown tree)."""
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_column), F.lit(""))
    placed = documents.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        descend(key, tree).cast("int").alias("shard"),
        descend(key, grown).cast("int").alias("grown_shard"),
        F.substring(F.md5(key), 1, GROUP_DIGITS).alias("__group"),
        F.coalesce(F.concat(F.lit("="), F.col(id_column).cast("string")), F.lit("")).alias("__key"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("__salt"),
    )
    placed = written(placed, "shards")  # the salt is fixed from here on
    same = ["shard", "__group", "__key", "size", "text_crc32", "__salt"]
    counts = placed.groupBy(*same, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "__group").agg(F.count(F.lit(1)).alias("n")).select("shard", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__group").orderBy("doc_id", "size", "text_crc32", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("__ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "__group"])
    firsts = firsts.select(*same, (F.col("__start") + F.col("__ahead")).alias("__first"))
    ranked = placed.join(firsts, same).withColumn("__rank", F.row_number().over(Window.partitionBy(*same).orderBy("grown_shard")) - 1)
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("__first") + F.col("__rank")).alias("slot"), "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), layout(SHARDS), layout(SHARDS + 1))


def oracle() -> str:
    """The same shards from DuckDB: with equal weights the least draw is the largest hash, ties to the lower shard."""

    def best(n: int) -> str:
        return f"list_position(list_transform(range({n}), lambda s: ('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT), list_max(list_transform(range({n}), lambda s: ('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT))) - 1"

    steps = []
    for c in range(256):  # the checksum's byte table, by its polynomial
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        steps.append(c)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
placed AS (SELECT doc_id, length(h) // 2 + 8 AS size,
  xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, {steps}[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
  {best(SHARDS)} AS shard, {best(SHARDS + 1)} AS grown_shard, substr(md5(k), 1, {GROUP_DIGITS}) AS g FROM texts)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY g, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed
"""
