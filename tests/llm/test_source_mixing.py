from __future__ import annotations

import math

import pytest

from tallyspan.llm import source_mixing as m
from tallyspan.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_exponents():
    totals = {"a": 800, "b": 100, "c": 100, "d": 0}
    assert m.tempered(totals, 1.0) == pytest.approx({"a": 0.8, "b": 0.1, "c": 0.1}) and m.tempered(totals, 0.0) == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3})
    exponent = m.bisect(totals, repeats=2.0)
    taken = m.rounds(totals, m.tempered(totals, exponent))
    assert taken["a"] == pytest.approx(1) and taken["b"] == pytest.approx(2, abs=1e-9) and taken["d"] == 1
    assert 8 ** (1 - exponent) == pytest.approx(2)
    wanted = 0.9
    assert m.entropy(m.tempered(totals, m.bisect(totals, None, wanted))) == pytest.approx(wanted)
    assert m.bisect(totals, None, math.log(3) + 1) == 0.0 and m.bisect({}, 2.0) == 0.0


def test_budgets_are_met_to_within_a_document(spark):
    documents = table(spark, SF, "documents").withColumn("source", m.F.when(m.F.col("doc_id") % 3 > 0, "hot").otherwise(m.F.col("source")))
    rows = m.mix(documents, repeats=1.6).collect()
    totals, got, longest = {}, {}, {}
    for r in rows:
        if r.mix_round == 0:
            totals[r.source] = totals.get(r.source, 0) + r.mix_tokens
        got[r.source] = got.get(r.source, 0) + r.mix_tokens
        longest[r.source] = max(longest.get(r.source, 0), r.mix_tokens)
    taken = m.rounds(totals, m.tempered(totals, m.bisect(totals, 1.6)))
    assert max(taken.values()) <= 1.6 + 1e-9
    for s, n in totals.items():
        assert 0 <= round(taken[s] * n) - got[s] <= longest[s]
    times = {}
    for r in rows:
        times.setdefault(r.doc_id, []).append(r.mix_round)
    assert len(times) == documents.count() and all(sorted(v) == list(range(len(v))) for v in times.values())


def test_rounds_permute_whole_blocks(spark):
    rows = m.mix(table(spark, SF, "documents"), repeats=3.0).collect()
    places = {}
    for r in rows:
        places.setdefault((r.source, r.mix_round), set()).add(r.mix_place)
    whole = [k for k in places if k[1] == 0]
    assert all(places[k] == set(range(len(places[k]))) for k in whole)


def test_awkward_rows(spark, awkward, nothing):
    out = m.mix(awkward)
    found = [r.doc_id for r in out.where("mix_round = 0").collect()]
    assert sorted(found, key=str) == sorted((r.doc_id for r in awkward.collect()), key=str)
    assert [c for c in out.columns if not c.startswith("mix_")] == [c for c in awkward.columns if c != "mix_round"]
    assert m.mix(nothing).count() == 0


def test_plan_by_key_equals_plan_by_broadcast(spark, monkeypatch):
    documents = table(spark, SF, "documents")
    one = m.mix(documents).select("doc_id", "mix_round", "mix_place")
    monkeypatch.setattr(m, "FEW_SOURCES", 0)
    two = m.mix(documents).select("doc_id", "mix_round", "mix_place")
    assert one.exceptAll(two).count() == 0 and one.count() == two.count()


@pytest.mark.parametrize("wanted", [{"repeats": 1.6}, {"repeats": None, "target_entropy": 3.0}])
def test_any_number_of_sources(spark, monkeypatch, wanted):
    documents = table(spark, SF, "documents").withColumn("source", m.F.concat("source", (m.F.col("doc_id") % 9).cast("string")))
    columns = ["doc_id", "mix_round", "mix_place", m.F.round("mix_weight", 9)]
    one = m.mix(documents, **wanted).select(*columns).collect()
    monkeypatch.setattr(m, "MOST_SOURCES", 3)
    two = m.mix(documents, **wanted).select(*columns).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) >= documents.count()


def plain_mix(spark, documents, repeats):
    """(row number, round, place) of every row taken, by walking through the blocks of each source one by one."""
    from collections import defaultdict

    F = m.F
    marked = documents.select(
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))).alias("at"), "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).alias("n"),
    ).collect()
    blocks, totals = defaultdict(list), defaultdict(int)
    for r in marked:
        blocks[r.s, (r["at"] >> 20) % m.BLOCKS].append(r)
        totals[r.s] += r.n
    weights = m.tempered(totals, m.bisect(totals, repeats))
    times = m.rounds(totals, weights)
    draws = spark.createDataFrame([(s, b, k) for s, b in blocks for k in range(int(times[s]) + 1)], "s string, b int, k int")
    drawn = {(r.s, r.b, r.k): r.d for r in draws.select("*", F.xxhash64("s", "b", "k").alias("d")).collect()}
    taken = []
    for s in totals:
        budget = round((times[s] - int(times[s])) * totals[s])
        for k in range(int(times[s]) + 1):
            before = 0
            for place, b in enumerate(sorted((b for t, b in blocks if t == s), key=lambda b: (drawn[s, b, k], b))):
                rows = blocks[s, b]
                size = sum(r.n for r in rows)
                if k < int(times[s]) or (budget > 0 and before + size <= budget):
                    taken += [(r.doc_id, r.s, k, place) for r in rows]
                elif before < budget:
                    spent = before
                    for at in sorted({r["at"] for r in rows}):
                        same = [r for r in rows if r["at"] == at]
                        spent += sum(r.n for r in same)
                        if spent > budget:
                            break
                        taken += [(r.doc_id, r.s, k, place) for r in same]
                before += size
    return taken


@pytest.mark.parametrize("repeats", [1.5, 2.0])
def test_rows_taken_equal_a_walk_through_all_blocks(spark, awkward, repeats):
    for documents in (table(spark, SF, "documents").select("doc_id", "text", "source"), awkward.select("doc_id", "text", "source")):
        found = [(r.doc_id, "" if r.source is None else "=" + r.source, r.mix_round, r.mix_place) for r in m.mix(documents, repeats=repeats).collect()]
        assert sorted(found, key=str) == sorted(plain_mix(spark, documents, repeats), key=str)


def test_awkward_rows_meet_a_wanted_entropy(spark, awkward):
    out = m.mix(awkward, repeats=None, target_entropy=1.0).collect()
    weights = {r.source: r.mix_weight for r in out}
    assert -sum(w * math.log(w) for w in weights.values() if w) == pytest.approx(1.0, abs=1e-6)
    assert {r.doc_id for r in out} == {r.doc_id for r in awkward.collect()}
