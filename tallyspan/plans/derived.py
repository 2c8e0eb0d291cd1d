"""Views that the SQL side derives for itself, written apart from the Spark operators they are compared with."""

from __future__ import annotations

from tallyspan.plans.views import DERIVED, NOW, TOLERANCE

DERIVED["held_promises"] = """
    SELECT DISTINCT p.promise_hash FROM publications p JOIN uncertain u ON u.holds AND p.promise_height - 1 <= u.to_height AND p.height >= u.from_height"""

DERIVED["checks"] = f"""
    SELECT *, CASE
      WHEN outcome IN ('PROBE_ERROR', 'RPC_DEADLINE') THEN 'PROBE_ERROR' WHEN outcome IN ('MISSED', 'REACHABLE') THEN 'NOT_PROBED'
      WHEN outcome = 'IDENTITY_FAIL' THEN CASE WHEN identity_stale THEN 'IDENTITY_EXPIRED' ELSE 'IDENTITY_MISMATCH' END
      WHEN outcome IN ('NO_REGISTERED_HOST', 'UNROUTABLE_HOST') THEN CASE WHEN assigned THEN 'NOT_REGISTERED' ELSE 'EXPECTED_UNASSIGNED' END
      WHEN pin_stale THEN 'PROBE_ERROR' WHEN assigned AND NOT attested AND NOT attestation_unknown THEN 'UNATTESTED'
      WHEN NOT assigned THEN CASE WHEN outcome IN ('SERVED_OK', 'PARTIAL', 'WRONG_ROWS', 'INVALID_ROWS') THEN 'SERVING_UNASSIGNED' ELSE 'EXPECTED_UNASSIGNED' END
      WHEN outcome IN ('WRONG_ROWS', 'PARTIAL') AND verified AND shadowed THEN 'SHADOWED_SHARD'
      WHEN outcome IN ('WRONG_ROWS', 'PARTIAL') AND verified AND shadow_uncertain THEN 'PROBE_ERROR'
      WHEN outcome = 'INVALID_ROWS' THEN 'FAULT'
      WHEN phase = 'post' THEN CASE WHEN outcome = 'NOT_FOUND' THEN 'EXPECTED_GONE' WHEN outcome IN ('SERVED_OK', 'WRONG_ROWS', 'PARTIAL') THEN 'SERVED_PAST_WINDOW' ELSE 'UNREACHABLE_POST_WINDOW' END
      WHEN outcome = 'SERVED_OK' THEN 'HEALTHY'
      WHEN outcome IN ('WRONG_ROWS', 'PARTIAL') THEN CASE WHEN verified THEN 'UNMATCHED_GENUINE' ELSE 'FAULT' END
      WHEN phase = 'grace' THEN 'TOLERATED'
      WHEN outcome = 'NOT_FOUND' THEN 'FAULT' WHEN outcome IN ('SERVER_ERROR', 'MALFORMED_SHARD') THEN 'SERVER_ERROR' WHEN outcome = 'RPC_THROTTLED' THEN 'THROTTLED'
      ELSE 'UNREACHABLE' END AS cls
    FROM (SELECT r.*, p.settled_us, p.must_serve_us, p.needed_rows, p.excess_rows, p.height, p.tx_index, p.commitment, h.promise_hash IS NOT NULL AS held,
            r.outcome = 'SERVED_OK' OR (r.outcome IN ('WRONG_ROWS', 'PARTIAL') AND r.rows_verify) AS verified,
            CASE WHEN r.started_us < p.must_serve_us THEN 'in_window' WHEN r.started_us <= p.must_serve_us + {TOLERANCE} THEN 'grace' ELSE 'post' END AS phase
          FROM raw_checks r JOIN publications p USING (promise_hash) LEFT JOIN held_promises h ON h.promise_hash = r.promise_hash)"""

_own = "verified AND (outcome = 'SERVED_OK' OR cls = 'SHADOWED_SHARD')"
_foreign = "verified AND cls <> 'SHADOWED_SHARD' AND (outcome = 'WRONG_ROWS' OR (outcome = 'PARTIAL' AND NOT subset_of_own))"
_reached = "(verified OR tcp_ok OR outcome = 'TCP_REFUSED')"

DERIVED["reading_facts"] = f"""
    SELECT g.promise_hash, g.scheduled_us, lower_rows - excess AS lower, upper, coalesce(have, 0) AS have, ran, missed, asked, served, endorsers, answered, end_label, needed, g.must_serve_us
    FROM (SELECT promise_hash, scheduled_us, coalesce(CAST(sum(CASE WHEN verified THEN rows_returned END) AS BIGINT), 0) AS upper, bool_or({_reached}) AS ran, max(needed_rows) AS needed,
            max(excess_rows) AS excess, max(must_serve_us) AS must_serve_us, bool_or(label IN ('end', 'full', 'enough')) AS end_label,
            count(DISTINCT CASE WHEN cls NOT IN ('NOT_PROBED', 'PROBE_ERROR') THEN validator END) AS asked, count(DISTINCT CASE WHEN verified THEN validator END) AS served,
            count(DISTINCT CASE WHEN assigned AND attested AND phase = 'in_window' THEN validator END) AS endorsers, count(DISTINCT CASE WHEN phase = 'in_window' AND {_reached} THEN validator END) AS answered
          FROM checks GROUP BY ALL) g
    JOIN (SELECT promise_hash, scheduled_us, CAST(sum(own) AS BIGINT) AS lower_rows FROM (SELECT promise_hash, scheduled_us, validator, coalesce(max(CASE WHEN outcome = 'SERVED_OK' THEN rows_returned END), 0) AS own FROM checks GROUP BY ALL) GROUP BY ALL) l USING (promise_hash, scheduled_us)
    LEFT JOIN (SELECT promise_hash, scheduled_us, count(DISTINCT i) AS have FROM (SELECT promise_hash, scheduled_us, unnest(range(first_row, first_row + rows_returned)) AS i FROM checks WHERE verified) GROUP BY ALL) e USING (promise_hash, scheduled_us)
    JOIN (SELECT promise_hash, scheduled_us, bool_or(m) AS missed FROM (SELECT c.promise_hash, c.scheduled_us, c.cls = 'NOT_PROBED' AND c.assigned AND c.phase = 'in_window' AND (c.label <> 'full' OR NOT EXISTS
            (SELECT 1 FROM checks o WHERE o.promise_hash = c.promise_hash AND o.scheduled_us = c.scheduled_us AND o.validator = c.validator AND o.cls <> 'NOT_PROBED')) AS m FROM checks c) GROUP BY ALL) m USING (promise_hash, scheduled_us)"""

DERIVED["reading_states"] = """
    SELECT *, needed > 0 AND (lower >= needed OR have >= needed) AS available, needed > 0 AND NOT (lower >= needed OR have >= needed) AND ran AND NOT missed AS unavailable FROM reading_facts"""

DERIVED["counted_checks"] = f"""
    SELECT c.*, CASE WHEN c.phase <> 'in_window' OR NOT c.assigned OR NOT c.attested THEN c.cls
      WHEN c.label = 'full' THEN CASE WHEN {_own} THEN CASE WHEN held AND outcome <> 'INVALID_ROWS' THEN 'RETENTION_UNVERIFIED' ELSE 'HEALTHY' END
        WHEN cls IN ('NOT_PROBED', 'PROBE_ERROR') THEN cls WHEN {_foreign} THEN 'NOT_COUNTED'
        WHEN EXISTS (SELECT 1 FROM checks o WHERE o.promise_hash = c.promise_hash AND o.scheduled_us = c.scheduled_us AND o.validator = c.validator AND ((o.verified AND (o.outcome = 'SERVED_OK' OR o.cls = 'SHADOWED_SHARD'))
             OR o.cls IN ('NOT_PROBED', 'PROBE_ERROR') OR (o.verified AND o.cls <> 'SHADOWED_SHARD' AND (o.outcome = 'WRONG_ROWS' OR (o.outcome = 'PARTIAL' AND NOT o.subset_of_own))) OR o.started_us > c.started_us)) THEN 'NOT_COUNTED'
        WHEN NOT r.ran THEN 'NOT_COUNTED' WHEN c.attempt_owed THEN 'NOT_COUNTED' WHEN held AND outcome <> 'INVALID_ROWS' THEN 'RETENTION_UNVERIFIED' ELSE 'FAULT' END
      WHEN verified THEN CASE WHEN held AND outcome <> 'INVALID_ROWS' THEN 'RETENTION_UNVERIFIED' ELSE 'HEALTHY' END
      WHEN cls = 'NOT_PROBED' THEN cls WHEN r.unavailable THEN CASE WHEN held AND outcome <> 'INVALID_ROWS' THEN 'RETENTION_UNVERIFIED' ELSE 'FAULT' END
      WHEN cls = 'PROBE_ERROR' THEN cls ELSE 'NOT_COUNTED' END AS counted
    FROM checks c JOIN reading_states r USING (promise_hash, scheduled_us)"""

DERIVED["obligation_rows"] = f"""
    SELECT validator, promise_hash, count(*) FILTER (counted = 'FAULT') AS faults, count(*) FILTER (counted = 'HEALTHY') AS healthy, count(*) FILTER (counted = 'RETENTION_UNVERIFIED') AS withheld,
      count(*) FILTER (counted = 'HEALTHY' AND (label IN ('end', 'full', 'enough') OR 4 * scheduled_us >= 3 * must_serve_us + settled_us)) AS late_healthy,
      count(*) FILTER (counted NOT IN ('NOT_PROBED', 'PROBE_ERROR')) AS attempted, count(*) FILTER (counted NOT IN ('NOT_PROBED', 'PROBE_ERROR') AND tls_ok) AS reached,
      max(CASE WHEN rn = 1 THEN counted END) AS last_cls, bool_or(must_serve_us > {NOW}) AS pending, min(CASE WHEN counted = 'FAULT' THEN started_us END) AS first_fault_us, max(settled_us) AS settled_us
    FROM (SELECT *, row_number() OVER (PARTITION BY validator, promise_hash ORDER BY cls IN ('NOT_PROBED', 'PROBE_ERROR'), scheduled_us DESC, started_us DESC, dedupe_key) AS rn FROM counted_checks
          WHERE phase = 'in_window' AND assigned AND attested AND settled_us <= {NOW} AND started_us <= {NOW}) GROUP BY ALL"""

DERIVED["bucketed"] = """
    SELECT *, CASE WHEN pending THEN 'pending' WHEN faults > 0 THEN 'broken' WHEN last_cls = 'HEALTHY' AND late_healthy > 0 THEN 'served' WHEN healthy > 0 THEN 'end_unobserved' WHEN withheld > 0 THEN 'held'
      WHEN reached > 0 THEN 'unobserved_reachable' WHEN attempted > 0 THEN 'unobserved_unreachable' ELSE 'unobserved_not_probed' END AS bucket FROM obligation_rows"""

#: The nine sums of obligations, as SQL.
SUMS_SQL = "count(*) AS total, " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in ("broken", "served", "end_unobserved", "held", "unobserved_reachable", "unobserved_unreachable", "unobserved_not_probed", "pending"))
