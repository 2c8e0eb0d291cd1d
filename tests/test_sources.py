from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile

from pyspark.sql import functions as F

from tallyspan.sources import records, sinks


def lines(path, rows, torn=""):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + torn)
    return str(path)


def test_records_are_typed_and_bad_lines_counted(spark, tmp_path):
    path = lines(tmp_path / "payments.jsonl", [{"dedupe_key": "a", "kind": "settlement", "height": 5, "amount_utia": 12}, {"dedupe_key": "b", "height": 6}])
    (tmp_path / "payments.jsonl").open("a").write("not json\n")
    rows = records.read_records(spark, path, "payments").orderBy("height").collect()
    assert [(r.dedupe_key, r.height) for r in rows] == [("a", 5), ("b", 6)]
    assert records.bad_lines(spark, path, "payments").first()["bad"] == 1


def test_a_torn_last_line_is_left_for_later(spark, tmp_path):
    path = lines(tmp_path / "registry.jsonl", [{"kind": "open", "height": 1}], torn='{"kind": "clo')
    assert records.read_records(spark, path, "registry", live=True).count() == 1


def test_segments_keep_their_order(spark, tmp_path):
    with gzip.open(tmp_path / "0.jsonl.gz", "wt") as f:
        f.write('{"kind":"a"}\n{"kind":"b"}\n')
    live = lines(tmp_path / "runs.jsonl", [{"kind": "c"}], torn='{"k')
    found = records.segmented(spark, [str(tmp_path / "0.jsonl.gz")], live).groupBy("segment").count().orderBy("segment").collect()
    assert [tuple(r) for r in found] == [(0, 2), (1, 1)]


def test_times_and_keys(spark):
    rows = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("2026-01-02T03:04:05.5Z",), ("2026-02-30T00:00:00Z",), ("soon",), (None,)], "t string")
    found = [r[0] for r in rows.select(records.canonical(F.col("t"))).collect()]
    assert found == ["2026-01-02T03:04:05.000000000Z", "2026-01-02T03:04:05.500000000Z", None, None, None]
    assert rows.limit(2).select(records.micros(records.canonical(F.col("t")))).collect()[1][0] % 1_000_000 == 500_000
    key = rows.limit(1).select(records.dedupe_key(F.lit("v"), F.lit("p"), F.lit("a"), F.col("t"), F.lit(2))).first()[0]
    assert key == "v|p|a|2026-01-02T03:04:05Z|2"


def test_ranges_and_addresses(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("# note\n1.0.0.0\t1.0.0.255\t13335\tAU\tx\n2001:db8::\t2001:db8::ff\t7\tZZ\ty\n1.0.0.0\t::1\t1\tA\tz\n")
    rows = records.read_ranges(spark, str(tmp_path / "r.tsv"), "\t", "start string, end string, asn long, country string, org string")
    assert sorted((r.asn, r.v6) for r in rows.collect()) == [(7, True), (13335, False)]
    addresses = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("127.0.0.1",), ("x",), (None,)], "a string")
    assert [r[0] for r in addresses.select(records.routable(F.col("a"))).collect()] == [True, False, False, False, False]


def test_exports_match_their_manifest(spark, tmp_path):
    data = b'{"kind":"a"}\n{"kind":"b"}\n'
    with tarfile.open(tmp_path / "day.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("runs.jsonl")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    members = records.read_exports(spark, str(tmp_path / "day.tar.gz"))
    listed = spark.createDataFrame([("runs.jsonl", 2, hashlib.sha256(data).hexdigest()), ("gone.jsonl", 1, "00")], "member string, lines long, sha256 string")
    assert {r.member: r.state for r in records.verified_exports(members, listed).collect()} == {"runs.jsonl": "ok", "gone.jsonl": "missing"}


def test_labels(spark):
    found = records.read_labels(spark, "publishers:\n  - address: a1\n    label: 'One'\n  - address: a2\n").collect()
    assert [(r.address, r.label) for r in found] == [("a1", "One"), ("a2", None)]


def test_insert_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    path = str(tmp_path / "t")
    assert sinks.insert_absent(rows, path, ["k"]) == 2
    assert sinks.insert_absent(rows, path, ["k"]) == 0
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]


def test_inserts_read_the_days_of_the_batch_only(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([(k, k // 10) for k in range(100)], "k long, day long")
    assert sinks.insert_absent(rows, path, ["k"], ["day"]) == 100
    again = spark.createDataFrame([(5, 0), (105, 0), (95, 9)], "k long, day long")
    assert sinks.insert_absent(again, path, ["k"], ["day"]) == 1 and sinks.insert_absent(again, path, ["k"], ["day"]) == 0
    assert spark.read.parquet(path).count() == 101


def test_states(spark):
    log = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, True, "y"), ("a", 3, False, "z"), ("b", 1, False, "p"), ("b", 2, False, "q")], "k string, n int, done boolean, v string")
    assert {r.k: r.v for r in sinks.latest_state(log, ["k"], [F.desc("n")]).collect()} == {"a": "z", "b": "q"}
    assert {r.k: r.v for r in sinks.guarded_state(log, ["k"], F.col("done"), [F.col("n")]).collect()} == {"a": "y", "b": "q"}


def test_reproduced(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, raw string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "k int, raw string")
    assert {r.k: r.state for r in sinks.reproduced(a, b, "k").collect()} == {1: "same", 2: "changed", 3: "lost", 4: "new"}


def test_manifest_counts_late_lines(spark):
    rows = spark.createDataFrame([("f", "x", "2026-01-01T00", "2026-01-01"), ("f", "y", "2026-01-01T05", "2026-01-02")], "file string, raw string, at string, exported string")
    found = sinks.manifest(rows, "at", "exported").first()
    assert (found.lines, found.late) == (2, 1)
