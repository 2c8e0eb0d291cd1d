from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspan.functions import codecs, streams
from tallyspan.operators import assignment as a
from tallyspan.operators import histories as h
from tallyspan.operators import market, paging, ranges, routes
from tallyspan.operators import quantiles as q
from tallyspan.operators import readings as read
from tallyspan.operators import rollups as roll
from tallyspan.operators.checks import held_promises
from tallyspan.plans.catalog import QUERIES
from tallyspan.plans.views import DAY, NOW, Views
from tests.oracle import FOLDER


#: What a heartbeat of each named state shows: whether it was answered, and the verdict on the identity.
SHOWN = {"verified": (True, "verified"), "silent": (False, ""), "expired": (True, "expired"), "mismatch": (True, "mismatch"), "unjudged": (True, "")}
SPACING = 7_000


def heartbeats(spark, lengths):
    """One validator's heartbeats from runs (state, length), ``SPACING`` apart."""
    states = [state for state, n in lengths for _ in range(n)]
    rows = [(k, 3, 1_000_000 + k * SPACING, *SHOWN[state], "h3") for k, state in enumerate(states)]
    return states, spark.createDataFrame(rows, "seq long, validator long, at_us long, up boolean, identity string, host string")


def drawn_runs(seed, states, many):
    draw = random.Random(seed)
    return [(draw.choice(states), draw.choice((1, 1, 2, 3, 4, 6))) for _ in range(many)]


def plain_changes(values, least=3):
    """Places where a value that lasts for ``least`` heartbeats begins, if it differs from the last such value, which goes with it (None for the first)."""
    found, settled, start = [], None, 0
    for k, value in enumerate(values):
        if k and values[k - 1] != value:
            start = k
        if k - start + 1 == least and value != settled:
            found.append((start, settled, value))
            settled = value
    return found


@pytest.mark.parametrize("seed", range(6))
def test_reachability_of_drawn_runs(spark, seed):
    states, rows = heartbeats(spark, drawn_runs(seed, ["verified", "silent"] if seed % 2 else [*SHOWN], 25))
    expected, down = [], None
    for start, was, up in plain_changes([SHOWN[s][0] for s in states]):
        at = 1_000_000 + start * SPACING
        if was is not None:
            expected.append(("recovered" if up else "unreachable", at, down if up else None))
        down = None if up else at
    found = sorted((r.at_us, r.kind, r.since_us) for r in h.transitions(rows).collect())
    assert [(kind, at) for at, kind, _ in found] == [(kind, at) for kind, at, _ in expected]
    assert [since for _, _, since in found if since] == [since for _, _, since in expected if since]


@pytest.mark.parametrize("seed", range(6, 12))
def test_identity_of_drawn_runs(spark, seed):
    states, rows = heartbeats(spark, drawn_runs(seed, [*SHOWN], 40))
    judged = [(k, SHOWN[s][1]) for k, s in enumerate(states) if SHOWN[s][0] and SHOWN[s][1]]
    expected, left = [], None
    for start, was, now in plain_changes([v for _, v in judged]):
        at = 1_000_000 + judged[start][0] * SPACING
        if was is None:
            continue
        expected.append((at, "identity_restored" if now == "verified" else "identity_problem", now, left if now == "verified" else None))
        left = at if was == "verified" else left
    assert sorted(tuple(r) for r in h.identity_transitions(rows).select("at_us", "kind", "identity", "since_us").collect()) == sorted(expected)


def test_no_change_without_a_lasting_one(spark):
    assert h.transitions(heartbeats(spark, [("verified", 9), ("silent", 2), ("verified", 4)])[1]).count() == 0
    assert h.transitions(heartbeats(spark, [("silent", 1)])[1]).count() == 0 and h.identity_transitions(heartbeats(spark, [("silent", 8)])[1]).count() == 0


def test_other_vantages_confirm(spark):
    draw = random.Random(4)
    rows = [(k, k % 2, draw.choice(("h1", "h2")), draw.choice(("v0", "v1", "v2")), draw.randrange(400), draw.random() < 0.6) for k in range(400)]
    frame = spark.createDataFrame(rows, "seq long, validator long, host string, vantage string, at_us long, up boolean")
    expected = []
    for seq, validator, host, vantage, at, up in rows:
        if not up:
            before = [r for r in rows if r[1:3] == (validator, host) and (r[4], r[0]) < (at, seq)]
            own = max((r for r in before if r[3] == vantage), key=lambda r: (r[4], r[0]), default=None)
            other = max((r for r in before if r[3] != vantage and r[4] > at - 5), key=lambda r: (r[4], r[0]), default=None)
            expected.append((seq, validator, bool(own and own[5]), "none" if other is None else "up" if other[5] else "down"))
    assert sorted(map(tuple, h.confirmed_elsewhere(frame, 5).collect())) == sorted(expected)


def test_runs_and_what_lies_between(spark):
    events = [("a", "v", 1, 10, "started"), ("a", "v", 1, 10, "started"), ("a", "v", 1, 15, "beat"), ("a", "v", 1, 30, "started"), ("a", "v", 1, 34, "beat"), ("a", "v", 2, 32, "started"), ("a", "v", 2, 50, "stopped"), ("a", "v", 2, 60, "started"), ("a", "v", 3, 5, "beat")]
    spans = h.run_spans(spark.createDataFrame(events, "component string, vantage string, pid long, at_us long, kind string"))
    assert sorted((r.pid, r.from_us, r.to_us, r.stopped) for r in spans.collect()) == [(1, 10, 15, False), (1, 30, 34, False), (2, 32, 50, True), (2, 60, 60, False)]
    assert sorted((r.from_us, r.to_us) for r in h.gaps_between(spans, ["component"]).collect()) == [(15, 30), (50, 60)]


def test_steps_of_repeated_events(spark):
    """Equal events differ in what lies before them: only the first one comes after the gap."""
    events = spark.createDataFrame([(1, 10, 0, "a"), (1, 50, 2, "b"), (1, 50, 2, "b"), (2, 50, 2, "b")], "validator long, height long, tx_index long, host string")
    steps = h.endpoint_steps(events, spark.createDataFrame([(20, 30)], "first long, last long")).collect()
    assert sorted((r.validator, r.height, r.previous or "", r.step) for r in steps) == [(1, 10, "", "before_record"), (1, 50, "a", "after_gap"), (1, 50, "b", "same"), (2, 50, "", "after_gap")]


def test_first_range_against_all_pairs(spark):
    draw = random.Random(5)
    listed = [(n, lo, lo + draw.choice([0, 0, 1, 6, 63, 64, 500, -1]), n % 3 == 0, f"as{n % 7}") for n, lo in enumerate(draw.randint(-300, 900) for _ in range(120))] + [(120, -(1 << 40), 1 << 61, True, "wide")]
    asked = [(n, draw.randint(-400, 1500), draw.random() < 0.5) for n in range(300)] + [(3, 7, True), (3, 8, False), (300, None, True), (301, 1 << 50, True)]
    points, known = spark.createDataFrame(asked, "key long, at long, v6 boolean"), spark.createDataFrame(listed, "line long, first long, last long, v6 boolean, asn string")
    found = ranges.first_range(points, known, "at", "v6", "asn")
    best = [next((asn for _, lo, hi, v6, asn in listed if v6 == of and at is not None and lo <= at <= hi), None) for _, at, of in asked]
    assert sorted((r.key, str(r.at), r.v6, str(r.asn)) for r in found.collect()) == sorted((k, str(at), of, str(b)) for (k, at, of), b in zip(asked, best, strict=True))
    assert {r.asn for r in ranges.first_range(points, known.limit(0), "at", "v6", "asn").collect()} == {None}


def test_provider_fallback_meets_no_pairs(spark, tmp_path):
    """Validators and ranges repeated: the rows that leave any operator of the plan do not grow with the pairs that meet."""
    for name in ("nation", "region"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, key in (("supplier", "s_suppkey"), ("part", "p_partkey")):
        rows = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        rows.crossJoin(spark.range(40).withColumnRenamed("id", "n")).withColumn(key, F.col(key) + F.col("n") * 200000).drop("n").write.parquet(str(tmp_path / f"{name}.parquet"))
    frame = QUERIES["provider_fallback"](spark, str(tmp_path))
    count = len(frame.collect())
    most, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
    assert count == 40 * spark.read.parquet(f"{FOLDER}/supplier.parquet").count() and 0 < most <= 2 * count


def test_pinned_permutations():
    # Permutations of the protocol's published row assignment, whose vectors every client must meet.
    assert streams.shuffled([bytes(32)], [16])[0] == [8, 13, 12, 0, 15, 14, 3, 10, 7, 2, 4, 11, 5, 1, 6, 9]
    assert streams.shuffled([bytes(range(1, 33))], [32])[0] == [17, 19, 28, 24, 1, 23, 13, 25, 18, 0, 15, 29, 3, 30, 20, 4, 10, 8, 9, 22, 26, 16, 2, 7, 11, 27, 6, 5, 31, 14, 12, 21]
    assert [sorted(p) for p in streams.shuffled([bytes([k]) * 32 for k in range(3)], [700, 1, 9])] == [list(range(700)), [0], list(range(9))]


def test_assigned_rows_cover_and_wrap(spark):
    members = spark.createDataFrame([(1, k, 10, 8) for k in range(3)] + [(2, 0, 5, 8), (3, 0, 1, 8), (3, 1, 999, 8)], "promise_hash long, validator long, power long, original long")
    blobs = spark.createDataFrame([(1, 7, 24), (2, 7, 24), (3, 9, 10)], "promise_hash long, commitment long, total_rows int")
    rows = {(r.promise_hash, r.validator): r.rows for r in a.assign(members, blobs).collect()}
    assert sorted(x for k in range(3) for x in rows[1, k]) == list(range(24))  # equal stakes cover the code exactly
    assert rows[2, 0] == rows[1, 0] and len(rows[3, 0]) == 2 and len(rows[3, 1]) == 8 and all(0 <= x < 10 for v in (rows[3, 0], rows[3, 1]) for x in v)


def test_assignment_sends_no_permutations(spark, monkeypatch):
    """Permutations are no side of a join; rows do not depend on how batches are cut, and a blob without rows assigns none."""
    members = spark.createDataFrame([(p, k, 3 + k, 20) for p in range(40) for k in range(5)], "promise_hash long, validator long, power long, original long")
    blobs = spark.createDataFrame([(p, p // 3, 0 if p == 39 else 10 + p % 4 * 30) for p in range(40)], "promise_hash long, commitment long, total_rows int")
    found = a.assign(members, blobs)
    assert found._jdf.queryExecution().optimizedPlan().toString().strip().startswith("MapInArrow")
    rows = found.collect()
    for r in rows:
        drawn = streams.shuffled([a.seed_of(r.commitment)], [r.total_rows])[0]
        assert r.rows == ([drawn[(r.offset + j) % r.total_rows] for j in range(r.row_count)] if r.total_rows else [])
    assert len(rows) == 200 and sum(r.total_rows == 0 for r in rows) == 5
    columns = ["commitment", "total_rows", "row_count", "offset"]
    batch = pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows])
    monkeypatch.setattr(a, "CELLS", 60)
    cut = list(a.slices([batch]))
    assert len(cut) > 40 and [x for b in cut for x in b.column("rows").to_pylist()] == [r.rows for r in rows]


def test_verify(spark):
    frame = spark.createDataFrame([([1, 2], [2, 1]), ([1], [2, 1]), ([3], [1]), ([], [1])], "got array<int>, own array<int>")
    assert [r[0] for r in frame.select(a.verify(F.col("got"), F.col("own"))).collect()] == ["exact", "subset", "foreign", "none"]


def test_bech32():
    assert codecs.encode("a", b"") == "a12uel5l" and codecs.decode("A12UEL5L") == ("a", b"")
    assert codecs.decode("a12uel5x") is None and codecs.decode("a12UEL5L") is None and codecs.decode("plain") is None
    for n in (1, 20, 32):
        assert codecs.decode(codecs.encode("val", bytes(range(n)))) == ("val", bytes(range(n)))


def test_quantiles_by_rows_and_by_histogram(spark):
    draw = random.Random(1)
    frame = spark.createDataFrame([(k, k % 3, draw.randint(0, 5000)) for k in range(900)], "k long, g long, v long")
    ask = {"p50": 50, "p95": 95, "p1": 1}
    one = q.from_rows(frame, ["g"], "v", ["k"], ask)
    two = q.from_histogram(q.merged(q.histogram(frame.withColumn("part", F.col("k") % 7), ["part", "g"], "v"), ["g"], "v"), ["g"], "v", ask)
    assert one.exceptAll(two).count() == 0 and one.count() == two.count() == 3
    values = sorted(r.v for r in frame.collect())
    assert q.two_pass(q.histogram(frame, [], "v"), "v", 95).first()[0] == values[(95 * 900 + 99) // 100 - 1]
    buckets = [r[0] for r in spark.range(1, 3000).select(q.octave_bucket(F.col("id"))).collect()]
    assert buckets == sorted(buckets)


def test_as_of_joins_agree(spark):
    draw = random.Random(4)
    left = spark.createDataFrame([(k, draw.randint(0, 400), draw.randint(0, 5)) for k in range(200)], "id long, height long, tx_index long")
    right = spark.createDataFrame([(n, draw.randint(0, 400), draw.randint(0, 5)) for n in range(30)], "v long, h long, t long")
    key = h.key
    one = ranges.as_of(left.withColumn("g", F.lit(0)), right.withColumn("g", F.lit(0)), ["g"], key("height", "tx_index"), key("h", "t"), ["v"]).select("id", "v")
    two = h.as_of_one_history(left, right.groupBy("h", "t").agg(F.max("v").alias("v")), key("height", "tx_index"), key("h", "t"), ["v"]).select("id", "v")
    rows = [(r.h, r.t, r.v) for r in right.collect()]
    plain = {r.id: max(((x, y, v) for x, y, v in rows if (x, y) <= (r.height, r.tx_index)), default=(0, 0, None))[2] for r in left.collect()}
    assert {r.id: r.v for r in one.collect()} == plain == {r.id: r.v for r in two.collect()}


def test_overlaps_equal_brute_force(spark):
    draw = random.Random(5)
    spans = [(k, x := draw.randint(0, 900), x + draw.randint(0, 200)) for k in range(60)]
    others = [(x := draw.randint(0, 900), x + draw.randint(0, 300), n) for n in range(20)]
    found = ranges.overlapping(spark.createDataFrame(spans, "k long, lo long, hi long"), spark.createDataFrame(others, "lo long, hi long, n long"), "k", keep="n")
    assert {tuple(r) for r in found.collect()} == {(k, n) for k, lo, hi in spans for x, y, n in others if lo <= y and hi >= x}


def test_rollups_equal_raw_after_changes(spark):
    checks = Views(spark, FOLDER).checks
    days = roll.class_days(checks)
    assert roll.merged_classes(days, []).exceptAll(checks.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))).count() == 0
    twice = days.unionByName(days)
    assert roll.merged_classes(twice, []).agg(F.sum("n")).first()[0] == 2 * checks.count()


def test_holds_and_corrections(spark):
    v = Views(spark, FOLDER)
    from tallyspan.operators.checks import corrected

    moved = corrected(v.publications, v.uncertain, DAY)
    assert moved.where("must_serve_us > was_us").count() == 0 and moved.where("must_serve_us < was_us").count() > 0
    again = corrected(moved.drop("was_us"), v.uncertain, DAY)
    assert again.where("must_serve_us <> was_us").count() == 0
    counted = read.counted(v.checks).where("held and phase = 'in_window' and assigned and attested and outcome <> 'INVALID_ROWS'")
    assert counted.where("counted in ('HEALTHY', 'FAULT')").count() == 0


def test_spans_and_pages(spark):
    assert routes.named_span("7d", NOW).start == NOW - 7 * DAY and routes.named_span("all", NOW, NOW - 5).end == NOW - 5 and routes.named_span(None, NOW).start == NOW - DAY
    for bad in (lambda: routes.named_span("1y", NOW), lambda: routes.named_span("7d", NOW, NOW + 1)):
        with pytest.raises(ValueError):
            bad()
    v = Views(spark, FOLDER)
    seen, cursor = [], (1 << 40, 0, 0)
    keys = ["height", "tx_index", "promise_hash"]
    while True:
        page = paging.before(v.publications, keys, cursor, 400).collect()
        seen += page[:400]
        if len(page) <= 400:
            break
        cursor = tuple(page[399][k] for k in keys)
    assert [tuple(r[k] for k in keys) for r in seen] == sorted((tuple(r[k] for k in keys) for r in v.publications.collect()), reverse=True)
    with pytest.raises(ValueError):
        routes.checks_page(v.checks, routes.named_span("all", NOW), 10)
    assert paging.filtered(v.publications, among={"promise_hash": []}).count() == 0


def test_dimensions(spark):
    hosts = spark.createDataFrame([("as1",), ("as9",)], "asn string")
    listed = spark.createDataFrame([("as1", "One")], "asn string, provider_name string")
    assert {r.asn: r.provider for r in routes.with_provider(hosts, listed).collect()} == {"as1": "One", "as9": "as9"}
    failed = spark.createDataFrame([("sdk", 5), ("x", 1)], "codespace string, code int")
    assert {r.codespace: r.reason for r in routes.explained(failed, [("sdk", 5, "insufficient funds")]).collect()} == {"sdk": "insufficient funds", "x": "code 1 x"}
    blocks = spark.createDataFrame([(k, k * 5) for k in range(50)], "height long, at_us long")
    paced = {r.height: r.pace_us for r in routes.pace(blocks).collect()}
    assert paced[10] == 6_000_000 and paced[45] == 5


def test_market_totals_join_every_publication(spark):
    """Blobs are told apart by key wherever the publication is on record, whatever its id, and by promise elsewhere."""
    pays = [(10, 5, "settlement"), (20, 6, "settlement"), (21, 7, "settlement"), (30, 8, "settlement"), (31, 9, "timeout")]
    payments = spark.createDataFrame([(p, at, kind, "a", "n", 3, 4, "unit") for p, at, kind in pays], "promise_hash long, at_us long, kind string, publisher string, namespace string, amount long, blob_size long, denom string")
    known = spark.createDataFrame([(10, 0, 7), (20, 0, 7), (21, 0, 7), (30, 1, 7)], "promise_hash long, blob_version long, commitment long")

    def blobs(publications):
        row = market.totals(payments, publications, 0, 100).first()
        return row.settlements, row.blobs

    assert blobs(known) == (4, 2)  # 10, 20 and 21 share version and commitment
    assert blobs(known.where("promise_hash <> 20")) == (4, 3)
    assert blobs(known.limit(0)) == (4, 4)


def test_hosts_of_every_settlement(spark):
    """Every validator of every promise, against a search of the whole history for each."""
    v = Views(spark, FOLDER)
    settled = {r.promise_hash: (r.height, r.tx_index) for r in v.publications.collect()}
    history: dict[int, list[tuple]] = {}
    for e in v.host_events.collect():
        history.setdefault(e.validator, []).append((e.height, e.tx_index, e.host))
    gaps = [(g.first, g.last) for g in v.scan_gaps.collect()]
    expected = []
    for a in v.assignments.collect():
        at = settled[a.promise_hash]
        height, _, host = max((e for e in history.get(a.validator, []) if e[:2] <= at), default=(0, 0, None))
        if any(last > height and first <= at[0] for first, last in gaps):
            expected.append((a.promise_hash, a.validator, "gap", ""))
        else:
            expected.append((a.promise_hash, a.validator, "no_seed" if host is None else "on_record" if host else "none", host or ""))
    found = [tuple(r) for r in QUERIES["host_at_settlement"](spark, FOLDER).collect()]
    assert sorted(found) == sorted(expected) and len({p for p, *_ in found if p % 3}) > 0


def test_every_waiting_check_holds_its_day(spark):
    v = Views(spark, FOLDER)
    waiting = {r.promise_hash for r in v.checks.where("cls = 'PROBE_ERROR' and shadow_uncertain").collect()}
    held = {r.promise_hash for r in held_promises(v.publications, v.uncertain).collect()}
    days: dict[int, list[bool]] = {}
    for p in v.publications.collect():
        days.setdefault(p.settled_us // DAY, []).append(p.must_serve_us <= NOW and p.promise_hash not in held | waiting)
    expected, rolled = [], True
    for day in sorted(days):
        rolled = rolled and all(days[day])
        expected.append((day, all(days[day]), len(days[day]), rolled))
    found = roll.final_days(v.publications, held_promises(v.publications, v.uncertain), v.checks.where("cls = 'PROBE_ERROR' and shadow_uncertain"), NOW)
    assert sorted(map(tuple, found.select("day", "final", "promises", "rolled").collect())) == expected
    assert any(p % 20 for p in waiting)
