"""Rules against plain evaluators over whole grids of their inputs."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tallyspan.functions import rules
from tallyspan.plans.views import OUTCOMES

FLAGS = ("assigned", "attested", "attestation_unknown", "verified", "shadowed", "shadow_uncertain", "identity_stale", "pin_stale")


def plain_class(o, phase, f):
    no_talk = o in ("DNS_FAIL", "TCP_REFUSED", "TCP_TIMEOUT", "TCP_UNREACHABLE", "TLS_HANDSHAKE_FAIL", "RPC_UNAVAILABLE", "RPC_ERROR", "RPC_TIMEOUT")
    wrong = o in ("SERVER_ERROR", "MALFORMED_SHARD")
    rows = o in ("WRONG_ROWS", "PARTIAL")
    if o in ("PROBE_ERROR", "RPC_DEADLINE"):
        return "PROBE_ERROR"
    if o in ("MISSED", "REACHABLE"):
        return "NOT_PROBED"
    if o == "IDENTITY_FAIL":
        return "IDENTITY_EXPIRED" if f["identity_stale"] else "IDENTITY_MISMATCH"
    if o in ("NO_REGISTERED_HOST", "UNROUTABLE_HOST"):
        return "NOT_REGISTERED" if f["assigned"] else "EXPECTED_UNASSIGNED"
    if f["pin_stale"]:
        return "PROBE_ERROR"
    if f["assigned"] and not f["attested"] and not f["attestation_unknown"]:
        return "UNATTESTED"
    if not f["assigned"]:
        if o in ("SERVED_OK", "PARTIAL", "WRONG_ROWS", "INVALID_ROWS"):
            return "SERVING_UNASSIGNED"
        return "EXPECTED_UNASSIGNED" if o == "NOT_FOUND" or no_talk or wrong or o == "RPC_THROTTLED" else "PROBE_ERROR"
    if rows and f["verified"] and (f["shadowed"] or f["shadow_uncertain"]):
        return "SHADOWED_SHARD" if f["shadowed"] else "PROBE_ERROR"
    if o == "INVALID_ROWS":
        return "FAULT"
    if phase == "post":
        if o == "NOT_FOUND":
            return "EXPECTED_GONE"
        if o == "SERVED_OK" or rows:
            return "SERVED_PAST_WINDOW"
        return "UNREACHABLE_POST_WINDOW" if wrong or no_talk or o == "RPC_THROTTLED" else "PROBE_ERROR"
    if o == "SERVED_OK":
        return "HEALTHY"
    if rows:
        return "UNMATCHED_GENUINE" if f["verified"] else "FAULT"
    if o == "NOT_FOUND":
        return "FAULT" if phase == "in_window" else "TOLERATED"
    if not (wrong or no_talk or o == "RPC_THROTTLED"):
        return "PROBE_ERROR"
    if phase == "grace":
        return "TOLERATED"
    return "SERVER_ERROR" if wrong else "UNREACHABLE" if no_talk else "THROTTLED"


def test_classification_over_every_cell(spark):
    cells = [(o, p, *flags) for o in [*OUTCOMES, "SOMETHING_NEW"] for p in ("in_window", "grace", "post") for flags in itertools.product((True, False), repeat=len(FLAGS))]
    frame = spark.createDataFrame(cells, "outcome string, phase string, " + ", ".join(f"{n} boolean" for n in FLAGS))
    found = frame.withColumn("cls", rules.classification(F.col("outcome"), F.col("phase"), {n: F.col(n) for n in FLAGS})).collect()
    assert len(found) == 24 * 3 * 256
    for r in found:
        assert r.cls == plain_class(r.outcome, r.phase, r.asDict()), r


def test_phase_edges(spark):
    rows = spark.createDataFrame([(99,), (100,), (110,), (111,)], "t long")
    assert [r[0] for r in rows.select(rules.phase(F.col("t"), F.lit(100), 10)).collect()] == ["in_window", "grace", "grace", "post"]


def test_end_segment_is_the_last_quarter(spark):
    rows = spark.createDataFrame([(174, "w1"), (175, "w1"), (0, "end")], "t long, label string")
    assert [r[0] for r in rows.select(rules.end_segment(F.col("t"), F.lit(100), F.lit(200), F.col("label"))).collect()] == [False, True, True]


def test_a_hold_hides_served_and_fault_but_not_invalid_rows(spark):
    rows = spark.createDataFrame([("HEALTHY", "SERVED_OK"), ("FAULT", "NOT_FOUND"), ("FAULT", "INVALID_ROWS"), ("TOLERATED", "NOT_FOUND")], "c string, o string")
    assert [r[0] for r in rows.select(rules.effective(F.col("c"), F.col("o"), F.lit(True))).collect()] == ["RETENTION_UNVERIFIED", "RETENTION_UNVERIFIED", "FAULT", "TOLERATED"]


def test_wilson_and_charge(spark):
    row = spark.range(1).select(rules.wilson(F.lit(9), F.lit(10), False).alias("low"), rules.wilson(F.lit(0), F.lit(0), True).alias("none"), rules.charge(F.lit(262_145), F.lit(11))[1].alias("fee")).first()
    assert abs(row.low - 0.5958) < 1e-3 and row.none is None and row.fee == (660_000 * 4 + 999) // 1000
