"""From record lines to figures: files, late verdicts, uncertain ranges, and the same lines as a stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import facts
from tallyspan.operators import obligations as obl
from tallyspan.operators import readings as read
from tallyspan.plans.views import DAY
from tallyspan.sources import records, synthetic
from tallyspan.streaming import passes

NOW = 100 * DAY


@pytest.fixture(scope="module")
def made(spark):
    """Lines of 60 promises kept by 4 validators, a fifth of them broken, and what becomes of them."""
    promised = synthetic.promises(spark, 60).withColumns({
        "height": F.col("promise_hash") + 10, "promise_height": F.col("promise_hash") + 9, "tx_index": F.lit(0).cast("long"), "tx_code": F.lit(0).cast("long"), "publisher": F.lit("p"), "namespace": F.lit("n"),
        "blob_size": F.lit(800).cast("long"), "blob_version": F.lit(1).cast("long"), "commitment": F.col("promise_hash"), "created_us": F.col("settled_us") - 5,
    })
    rows, truth = synthetic.checks(promised, 4, broken=0.2)
    assigned = rows.select("promise_hash", "validator", F.lit(4).alias("row_count"), F.lit(True).alias("attested"), F.lit("h").alias("host_at_settlement"))
    no = ("attestation_unknown", "shadowed", "shadow_uncertain", "identity_stale", "pin_stale")
    checks = rows.withColumns({n: F.lit(False) for n in no} | {"rows_verify": F.col("verified")})
    said = [r.value for r in synthetic.publication_lines(promised, assigned).collect()]
    seen = [r.value for r in synthetic.measurement_lines(checks).collect()]
    return said, seen, {int(r.validator): (r.total, r.broken, r.served) for r in truth.collect()}


def sums(classified):
    found = obl.sums(obl.obligations(obl.population(read.counted(classified), None, NOW), NOW), ["validator"])
    return {int(r.validator): (r.total, r.broken, r.served) for r in found.collect()}


def files(folder, kind, lines, torn=""):
    folder.mkdir(exist_ok=True)
    (folder / f"{kind}.jsonl").write_text("\n".join(lines) + "\n" + torn)
    return str(folder / f"{kind}.jsonl")


def test_files_give_the_injected_truth(spark, made, tmp_path):
    said, seen, truth = made
    one = records.read_records(spark, files(tmp_path, "publications", said), "publications")
    two = records.read_records(spark, files(tmp_path, "measurements", [*seen, "no json at all"], '{"outcome": "SERVED'), "measurements", live=True)
    rows = facts.recomputed(one, two)
    assert rows.count() == 240 and sums(rows) == truth and sum(b for _, b, _ in truth.values()) > 20
    load = {r.validator: r["rows"] for r in facts.assignments(one).groupBy("validator").agg(F.sum("row_count").alias("rows")).collect()}
    assert load == {str(k): 240 for k in range(4)}


def test_recorded_phases_and_classes_are_checked(spark, made, tmp_path):
    said, seen, _ = made
    lines = [json.loads(line) for line in seen[:6]]
    for k, line in enumerate(lines):
        line["phase"] = "in_window" if k != 1 else "post"
        line["classification"] = ("FAULT" if line["outcome"] == "NOT_FOUND" else "HEALTHY") if k != 2 else "TOLERATED"
    one = records.read_records(spark, files(tmp_path, "publications", said), "publications")
    two = records.read_records(spark, files(tmp_path, "measurements", map(json.dumps, lines)), "measurements")
    found = facts.differing(facts.recomputed(one, two), two).collect()
    assert sorted((r.recorded_phase, r.recorded_cls) for r in found) == sorted([("post", lines[1]["classification"]), ("in_window", "TOLERATED")])


def test_late_verdicts_and_uncertain_ranges(spark, made, tmp_path):
    said, seen, _ = made
    bad = [json.loads(line) for line in seen if json.loads(line)["outcome"] == "NOT_FOUND"]
    key = lambda m: (m["promise_hash"], m["validator_address"])
    late = [{"promise_hash": m["promise_hash"], "validator_address": m["validator_address"], "scheduled_at": m["scheduled_at"], "to": to, "judged_at": at} for m in bad[:1] for to, at in (("SHADOWED_SHARD", "2030-01-02T00:00:00Z"), ("PROBE_ERROR", "2030-01-01T00:00:00Z"))]
    held = int(bad[len(bad) // 2]["promise_hash"])
    ranges = [{"id": "a", "from_height": held + 10, "to_height": held + 10, "detected_at": "2030-01-01T00:00:00Z"}, {"id": "b", "from_height": 0, "to_height": 500, "detected_at": "2030-01-01T00:00:00Z"}, {"id": "b", "from_height": 0, "to_height": 500, "detected_at": "2030-01-01T00:00:00Z", "resolution": "same", "resolved_at": "2030-01-03T00:00:00Z"}]
    one = records.read_records(spark, files(tmp_path, "publications", said), "publications")
    two = records.read_records(spark, files(tmp_path, "measurements", seen), "measurements")
    rows = facts.recomputed(one, two, records.read_records(spark, files(tmp_path, "param_uncertainty", map(json.dumps, ranges)), "param_uncertainty"), records.read_records(spark, files(tmp_path, "amendments", map(json.dumps, late)), "amendments"))
    found = {(r.promise_hash, r.validator): (r.cls, r.held) for r in rows.collect()}
    assert found[key(bad[0])][0] == "SHADOWED_SHARD" and len(found) == 240
    assert {int(p) for (p, _), (_, h) in found.items() if h} == {held, held + 1, held + 2} & set(range(60))  # a promise spans the height before it was made up to its settlement


def test_not_found_near_the_deadline_is_judged_by_the_end_of_the_answer(spark, made, tmp_path):
    said, seen, _ = made
    line = json.loads(next(s for s in seen if json.loads(s)["outcome"] == "NOT_FOUND"))
    end = next(json.loads(s)["must_serve_until"] for s in said if json.loads(s)["promise_hash"] == line["promise_hash"])
    us = spark.createDataFrame([(end,)], "t string").select(records.micros(records.canonical(F.col("t"))).alias("us")).first().us
    text = lambda at: spark.createDataFrame([(at,)], "t long").select(synthetic.text_of("t").alias("s")).first().s
    cases = {"a": (us - 40_000_000, us - 35_000_000, "FAULT"), "b": (us - 40_000_000, us - 20_000_000, "TOLERATED"), "c": (us + 1, us + 2, "TOLERATED"), "d": (us - 40_000_000, us - 35_000_000, "TOLERATED")}
    lines = [line | {"vantage": v, "started_at": text(a), "finished_at": text(b)} | ({"clock_offset_ms": -6000} if v == "d" else {}) for v, (a, b, _) in cases.items()]
    one = records.read_records(spark, files(tmp_path, "publications", said), "publications")
    two = records.read_records(spark, files(tmp_path, "measurements", map(json.dumps, lines)), "measurements")
    assert {r.vantage: r.cls for r in facts.recomputed(one, two).collect()} == {v: c for v, (_, _, c) in cases.items()}


def test_a_stream_of_the_lines_ends_in_the_same_figures(spark, made, tmp_path):
    """Measurements come before the promises that they are of, in several files and some of them twice."""
    said, seen, truth = made
    folder = tmp_path / "in"
    folder.mkdir()
    collector = passes.Collector(spark, str(tmp_path / "store"), {"publications": ["promise_hash"], "measurements": ["dedupe_key"]}, {"measurements": ("publications", "promise_hash")})

    def one_pass(batch, _):
        batch = batch.persist()
        made_of = {"publications": facts.publications, "measurements": facts.checks}
        lines = {k: records.parsed(batch.where(F.col("kind") == k).select("value"), k).where("not bad").select("record.*") for k in made_of}
        collector.run_pass({k: f(lines[k]) for k, f in made_of.items()})
        batch.unpersist()

    def drain():
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/([a-z]+)-\d+\.jsonl$", 1)
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).withColumn("kind", name)
        query = stream.writeStream.foreachBatch(one_pass).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()

    like = facts.checks(records.parsed(spark.createDataFrame([], "value string"), "measurements").select("record.*"))
    (folder / "measurements-1.jsonl").write_text("\n".join(seen[:150]) + "\n")
    drain()
    assert collector.waiting("measurements", like).count() == 150
    (folder / "publications-1.jsonl").write_text("\n".join(said) + "\n")
    drain()
    (folder / "measurements-2.jsonl").write_text("\n".join(seen[100:]) + "\n")
    drain()
    assert collector.waiting("measurements", like).count() == 0
    promised = facts.publications(records.parsed(spark.createDataFrame([], "value string"), "publications").select("record.*"))
    known, checks = collector.table("publications", promised), collector.table("measurements", like)
    from tallyspan.operators.checks import classified

    ranges = known.limit(0).select(F.col("height").alias("from_height"), F.col("height").alias("to_height"), F.lit(True).alias("holds"))
    assert sums(classified(checks, known, ranges, 150_000_000)) == truth
