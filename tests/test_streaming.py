from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyspan.sources import records
from tallyspan.streaming import passes, tail


def test_growing_file_is_read_line_by_line_once(spark, tmp_path):
    spark.dataSource.register(tail.GrowingLines)
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    live = source / "registry.jsonl"
    live.write_text('{"kind":"a","height":1}\n{"kind":"b"')

    def drain():
        rows = spark.readStream.format("growing_lines").option("path", str(source / "*.jsonl")).load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", state).start(out)
        query.processAllAvailable()
        query.stop()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    assert drain() == ['{"kind":"a","height":1}']
    with live.open("a") as f:
        f.write(',"height":2}\n{"kind":"c","height":3}\n')
    assert [json.loads(v)["kind"] for v in drain()] == ["a", "b", "c"]
    assert [json.loads(v)["kind"] for v in drain()] == ["a", "b", "c"]


def test_slices_end_at_newlines(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"aaa\nbb\ncccc\nd")
    assert tail.whole_lines_end(str(path), 0, 13) == 12
    assert tail.cuts(str(path), 0, 12, 5) == [(0, 7), (7, 12)]


def test_records_wait_for_what_they_refer_to(spark, tmp_path):
    collector = passes.Collector(spark, str(tmp_path), {"publications": ["promise_hash"], "measurements": ["key"]}, {"measurements": ("publications", "promise_hash")})
    checks = spark.createDataFrame([("k1", "p1"), ("k2", "p2")], "key string, promise_hash string")
    pubs = lambda *names: spark.createDataFrame([(n,) for n in names], "promise_hash string")
    assert collector.take("publications", pubs("p1")) == 1
    assert collector.take("measurements", checks) == 1
    assert collector.take("publications", pubs("p1", "p2")) == 1
    assert collector.take("measurements", checks.limit(0)) == 1
    assert collector.take("measurements", checks) == 0


def test_a_pass_inserts_in_order(spark, tmp_path):
    collector = passes.Collector(spark, str(tmp_path), {"publications": ["promise_hash"], "measurements": ["key"]}, {"measurements": ("publications", "promise_hash")})
    batches = {"measurements": spark.createDataFrame([("k1", "p1")], "key string, promise_hash string"), "publications": spark.createDataFrame([("p1",)], "promise_hash string")}
    assert collector.run_pass(batches) == {"publications": 1, "measurements": 1}
    assert collector.run_pass(batches) == {"publications": 0, "measurements": 0}


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "beats"
    rows = spark.createDataFrame([(k, k % 3, 1_000_000 * 600 * k, k % 4 > 0) for k in range(60)], "seq long, validator long, at_us long, up boolean")
    rows.repartition(4).write.parquet(str(source))
    collector = passes.Collector(spark, str(tmp_path / "out"), {"beats": ["seq"]})
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = stream.writeStream.foreachBatch(collector.sink("beats")).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert collector.table("beats", rows).exceptAll(rows).count() == 0 and collector.table("beats", rows).count() == 60


def test_days_are_refreshed_alone(spark, tmp_path):
    from tallyspan.operators.rollups import class_days, day_of
    from tallyspan.plans.views import DAY

    rows = spark.createDataFrame([(k % 5 * DAY + k, k % 3, "HEALTHY" if k % 2 else "FAULT") for k in range(100)], "started_us long, validator long, cls string")
    path = str(tmp_path / "days")
    class_days(rows.where("validator < 2")).write.partitionBy("day").parquet(path)
    late = rows.where("validator = 2 and started_us < 1000000")

    def recompute(stale):
        return class_days(rows.where("validator < 2").unionByName(late).withColumn("day", day_of(F.col("started_us"))).join(stale, "day", "left_semi"))

    passes.refresh_days(spark, late, "started_us", recompute, path)
    days = spark.read.parquet(path)
    assert days.where("day = 0 and validator = 2").count() == 1 and days.where("validator = 2").count() == 1
    assert days.select("day").distinct().count() == 5


def test_hourly_counts_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 2, k * 1_200_000_000, True) for k in range(30)], "seq long, validator long, at_us long, up boolean")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = passes.hourly_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "at_us")
    query = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(beats) from hourly").first()[0] == 30


def test_schemas_parse(spark):
    for kind in records.SCHEMAS:
        assert spark.createDataFrame([("{}",)], "value string").select(F.from_json("value", records.SCHEMAS[kind])).count() == 1
