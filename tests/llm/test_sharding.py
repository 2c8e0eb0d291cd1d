from __future__ import annotations

import hashlib
import math
import zlib

from pyspark.sql import functions as F

from tallyspan.llm import sharding as s
from tests.oracle import FOLDER, same


def plain(key, tree):
    def draw(x):
        bits = int(hashlib.md5(f"{key}:{x.number}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / x.weight

    return min(tree, key=lambda x: (draw(x), x.number)).number


def test_equals_sql(spark):
    assert same(spark, s.op7_sharding, s.oracle(), FOLDER) == 200


def test_awkward_rows(spark, awkward, nothing):
    rows = s.shard(awkward, s.layout(24), s.layout(25)).collect()
    texts = {r.doc_id: r.text for r in awkward.collect()}
    assert len(rows) == awkward.count() and s.shard(nothing, s.layout(24), s.layout(25)).count() == 0
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(data) + 8, zlib.crc32(data), plain(key, s.layout(24)), plain(key, s.layout(25)))
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_equal_rows_are_spread(spark):
    """A third of all rows with one id and one text, a third without an id: no window or join has them in one partition."""
    rows = spark.range(6000).selectExpr("case id % 3 when 0 then 7 when 1 then null else id end as doc_id", "case id % 3 when 2 then string(id) else 'same' end as text")
    out = s.shard(rows, s.layout(24), s.layout(25)).persist()
    for shard, slots in {r.shard: r.s for r in out.groupBy("shard").agg(F.collect_list("slot").alias("s")).collect()}.items():
        assert sorted(slots) == list(range(len(slots))), shard
    assert out.count() == 6000
    plan = s.shard(rows, s.layout(24), s.layout(25))._jdf.queryExecution().optimizedPlan().toString()
    ranks = [w for w in plan.split("\n") if "row_number" in w and "Window" in w]
    assert ranks and all("__salt" in w for w in ranks)  # the other windows are over counts


def test_growth_moves_rows_into_the_new_shard_only(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    for n in (5, 24, 25, 31):
        found = s.shard(rows, s.layout(n), s.layout(n + 1)).select("shard", "grown_shard").collect()
        moved = [r for r in found if r.shard != r.grown_shard]
        assert all(r.grown_shard == n for r in moved) and 0.4 < len(moved) * (n + 1) / 4000 < 1.7


def test_weights_are_met_and_moves_stay_in_the_changed_subtree(spark):
    tree = [s.Shard(0, 0, 0, 1.0), s.Shard(1, 0, 0, 3.0), s.Shard(2, 1, 0, 2.0), s.Shard(3, 2, 1, 2.0)]
    heavier = [*tree[:3], s.Shard(3, 2, 1, 4.0)]
    rows = spark.range(8000).selectExpr("id as doc_id", "'' as text")
    found = s.shard(rows, tree, heavier).select("shard", "grown_shard").collect()
    share = [sum(r.shard == k for r in found) / 8000 for k in range(4)]
    assert all(abs(a - b) < 0.02 for a, b in zip(share, (1 / 8, 3 / 8, 2 / 8, 2 / 8), strict=True))
    assert all(r.grown_shard == 3 for r in found if r.shard != r.grown_shard)


def test_plan_is_native(spark):
    plan = s.op7_sharding(spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
