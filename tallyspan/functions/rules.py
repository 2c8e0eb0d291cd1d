"""Rules of a single check: phase, class, served, gap, reached, effective class.

Each rule is a Column over the columns of a checks table; order of branches is part of the meaning.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcomes that mean no conversation came about, and answers that are no shard.
UNREACHED = ("DNS_FAIL", "TCP_REFUSED", "TCP_TIMEOUT", "TCP_UNREACHABLE", "TLS_HANDSHAKE_FAIL", "RPC_UNAVAILABLE", "RPC_ERROR", "RPC_TIMEOUT")
BAD_ANSWERS = ("SERVER_ERROR", "MALFORMED_SHARD")
GAPS = ("NOT_PROBED", "PROBE_ERROR")
END_LABELS = ("end", "full", "enough")
#: Readings labelled "end" that start from this moment on are full readings (2026-10-02T16:09:49Z).
FULL_SINCE = 1_790_957_389_000_000
#: How long after an answer a shard that was not found may still have been due.
NOT_FOUND_GUARD_US = 30_000_000


# Outcomes that the classes are told apart by, beside those above.
ROWS = ("WRONG_ROWS", "PARTIAL")
NO_HOST = ("NO_REGISTERED_HOST", "UNROUTABLE_HOST")
OTHERS = ("SERVED_OK", "NOT_FOUND", "INVALID_ROWS", "RPC_THROTTLED", "RPC_DEADLINE", "IDENTITY_FAIL", "PROBE_ERROR", "MISSED", "REACHABLE")


def phase(started: Column, must_serve: Column, tolerance: int) -> Column:
    return F.when(started < must_serve, "in_window").when(started <= must_serve + tolerance, "grace").otherwise("post")


# The names of classes in what follows, in the record format's spelling.
def _by_phase(outcome: str, genuine: bool) -> tuple[str, str, str]:
    """The class of an answer of an endorsing validator in the window, in the grace after it and past both."""
    silent = outcome in UNREACHED or outcome in BAD_ANSWERS or outcome == "RPC_THROTTLED"
    if outcome == "SERVED_OK":
        return "HEALTHY", "HEALTHY", "SERVED_PAST_WINDOW"
    if outcome == "NOT_FOUND":
        return "FAULT", "TOLERATED", "EXPECTED_GONE"
    if outcome == "INVALID_ROWS":
        return "FAULT", "FAULT", "FAULT"
    if outcome in ROWS:
        return ("UNMATCHED_GENUINE", "UNMATCHED_GENUINE", "SERVED_PAST_WINDOW") if genuine else ("FAULT", "FAULT", "SERVED_PAST_WINDOW")
    if silent:
        return "SERVER_ERROR" if outcome in BAD_ANSWERS else "THROTTLED" if outcome == "RPC_THROTTLED" else "UNREACHABLE", "TOLERATED", "UNREACHABLE_POST_WINDOW"
    return "PROBE_ERROR", "PROBE_ERROR", "PROBE_ERROR"


def _unassigned(outcome: str) -> str:
    if outcome in ("SERVED_OK", "INVALID_ROWS", *ROWS):
        return "SERVING_UNASSIGNED"
    return "EXPECTED_UNASSIGNED" if outcome in ("NOT_FOUND", "RPC_THROTTLED", *UNREACHED, *BAD_ANSWERS) else "PROBE_ERROR"


def _answers(outcome: str) -> list[str]:
    """The classes of an outcome by case, and within it by whether the identity is stale.

    Cases: the pin is stale and the validator assigned, or not; no endorsement; not assigned; then by phase each: verified rows of
    another's shard, perhaps of another's, verified, not verified. What concerns the observer comes first, then the
    endpoint, then what was promised, then the phase.
    """
    shadowed = ["SHADOWED_SHARD"] * 3 if outcome in ROWS else [*_by_phase(outcome, True)]
    uncertain = ["PROBE_ERROR"] * 3 if outcome in ROWS else [*_by_phase(outcome, True)]
    cases = ["PROBE_ERROR", "PROBE_ERROR", "UNATTESTED", _unassigned(outcome), *shadowed, *uncertain, *_by_phase(outcome, True), *_by_phase(outcome, False)]
    if outcome in ("PROBE_ERROR", "RPC_DEADLINE"):
        cases = ["PROBE_ERROR"] * len(cases)
    if outcome in ("MISSED", "REACHABLE"):
        cases = ["NOT_PROBED"] * len(cases)
    if outcome in NO_HOST:
        cases = ["EXPECTED_UNASSIGNED" if k in (1, 3) else "NOT_REGISTERED" for k in range(len(cases))]
    if outcome == "IDENTITY_FAIL":
        return ["IDENTITY_MISMATCH", "IDENTITY_EXPIRED"] * len(cases)
    return [c for case in cases for c in (case, case)]


@cache
def _class_table() -> str:
    """All answers as one map literal; the empty outcome stands for every other one."""
    rows = (f"'{o}', array({', '.join(map(repr, _answers(o)))})" for o in (*UNREACHED, *BAD_ANSWERS, *ROWS, *NO_HOST, *OTHERS, ""))
    return f"map({', '.join(rows)})"


def classification(outcome: Column, stage: Column, flag: dict[str, Column]) -> Column:
    """The class of a check from its outcome, its phase and its evidence: one look into a table of all cases.

    ``flag`` has assigned, attested, attestation_unknown, verified, shadowed, shadow_uncertain, identity_stale and
    pin_stale; a null flag decides nothing, a null ``assigned`` counts as not assigned.
    """
    assigned = F.coalesce(flag["assigned"], F.lit(False))
    step = F.when(stage == "in_window", 0).when(stage == "grace", 1).otherwise(2)
    case = (
        F.when(flag["pin_stale"], F.when(assigned, 0).otherwise(1))
        .when(assigned & ~flag["attested"] & ~flag["attestation_unknown"], 2)
        .when(~assigned, 3)
        .otherwise(step + F.when(flag["verified"] & flag["shadowed"], 4).when(flag["verified"] & flag["shadow_uncertain"], 7).when(flag["verified"], 10).otherwise(13))
    )
    table = F.expr(_class_table())
    return F.get(F.coalesce(F.element_at(table, outcome), F.element_at(table, F.lit(""))), case * 2 + F.when(flag["identity_stale"], 1).otherwise(0))


def effective(cls: Column, outcome: Column, held: Column) -> Column:
    """What a deadline decided is withheld while the deadline is not certain; rows that fail the commitment are not."""
    return F.when(held & cls.isin("HEALTHY", "FAULT") & (outcome != "INVALID_ROWS"), "RETENTION_UNVERIFIED").otherwise(cls)


def full_reading(label: Column, started: Column) -> Column:
    return (label == "full") | ((label == "end") & (started >= FULL_SINCE))


def full_served(verified: Column, outcome: Column, cls: Column) -> Column:
    return verified & ((outcome == "SERVED_OK") | (cls == "SHADOWED_SHARD"))


def full_foreign(verified: Column, outcome: Column, cls: Column, subset: Column) -> Column:
    return verified & (cls != "SHADOWED_SHARD") & ((outcome == "WRONG_ROWS") | ((outcome == "PARTIAL") & ~subset))


def reached(verified: Column, tcp_ok: Column, outcome: Column) -> Column:
    return verified | tcp_ok | (outcome == "TCP_REFUSED")


def end_segment(scheduled: Column, settled: Column, must_serve: Column, label: Column) -> Column:
    """Whether a reading speaks for the end of the window: by its label, or in the window's last quarter."""
    return label.isin(*END_LABELS) | ((scheduled - must_serve) * 4 >= settled - must_serve)


# The edges and names of load bands.
def load_band(rows: Column) -> Column:
    return F.when(rows <= 148, "floor").when(rows < 1024, "low").when(rows < 2731, "mid").otherwise("high")


def rate_tone(rate: Column, rated: Column) -> Column:
    return F.when(rated < 20, "unranked").when(rate >= 0.98, "good").when(rate >= 0.90, "warn").otherwise("bad")


def wilson(hits: Column, n: Column, upper: bool, z: float = 1.96) -> Column:
    """A bound of the Wilson interval of hits out of n; null for none."""
    p = hits.cast("double") / F.nullif(n.cast("double"), F.lit(0.0))
    spread = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z
    middle = p + z * z / (2 * n)
    return F.when(n > 0, ((middle + spread) if upper else (middle - spread)) / (1 + z * z / n))


def charge(size: Column, app_version: Column, base: int = 650_000, per_chunk: int = 5_000, chunk: int = 262_144) -> tuple[Column, Column]:
    """Gas of a blob and what it is charged: gas is (base + per chunk * chunks); from version 11 on at 0.004, rounded up."""
    gas = F.lit(base) + F.ceil(size / F.lit(chunk)).cast("long") * per_chunk
    return gas, F.when(app_version < 11, gas).otherwise(F.floor((gas * 4 + 999) / 1000).cast("long"))
