"""Domain views: the test tables read as promises, assignments, checks, beats, payments and histories.

One text per view serves Spark and DuckDB, so both start from equal rows; what operators do with them is written
separately on either side. ``US(x)`` is microseconds since the epoch, ``//`` integer division.

All mappings are whole-number arithmetic on keys; none has a meaning of its own.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

DAY = 86_400_000_000
HOUR = 3_600_000_000
#: The moment that figures are asked for, and how long after a deadline a missing shard is tolerated.
NOW = 883_612_800_000_000  # 1998-01-01
TOLERANCE = DAY
EPOCH = 788_918_400_000_000  # 1995-01-01

# Outcomes of a check, in the record format's spelling.
OUTCOMES = (
    "SERVED_OK", "NOT_FOUND", "WRONG_ROWS", "INVALID_ROWS", "PARTIAL", "DNS_FAIL", "TCP_REFUSED", "TCP_TIMEOUT",
    "TCP_UNREACHABLE", "TLS_HANDSHAKE_FAIL", "IDENTITY_FAIL", "RPC_UNAVAILABLE", "SERVER_ERROR", "RPC_THROTTLED",
    "RPC_DEADLINE", "RPC_TIMEOUT", "MALFORMED_SHARD", "NO_REGISTERED_HOST", "UNROUTABLE_HOST", "RPC_ERROR",
    "PROBE_ERROR", "MISSED", "REACHABLE",
)

_outcome = "CASE (l_partkey + l_linenumber) % 29 " + " ".join(f"WHEN {k} THEN '{o}'" for k, o in enumerate(OUTCOMES)) + " ELSE 'SERVED_OK' END"

VIEWS = {
    "publications": f"""
        SELECT o_orderkey AS promise_hash, o_custkey AS publisher, US(o_orderdate) AS settled_us, US(o_orderdate) - (o_orderkey % 5) * {HOUR} AS created_us,
          (US(o_orderdate) - {EPOCH}) // {DAY} AS height, CAST(o_orderkey % 10 AS BIGINT) AS tx_index, (US(o_orderdate) - {EPOCH}) // {DAY} - o_orderkey % 3 AS promise_height,
          CAST(floor(o_totalprice) AS BIGINT) AS blob_size, o_orderkey // 3 AS commitment, CAST(o_orderkey % 2 AS BIGINT) AS blob_version,
          US(o_orderdate) + (60 + (o_orderkey % 4) * 150) * {DAY} AS must_serve_us,
          CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 10 + o_orderkey % 60 END AS needed_rows, CAST(o_orderkey % 4 AS BIGINT) AS excess_rows,
          CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'ns' || CAST(o_custkey % 17 AS VARCHAR(9)) END AS namespace,
          CASE WHEN o_orderkey % 50 = 0 THEN 5 ELSE 0 END AS tx_code, o_orderkey % 7 = 0 AS sampled_out
        FROM orders""",
    "assignments": """
        SELECT l_orderkey AS promise_hash, l_suppkey AS validator, CAST(floor(max(l_quantity)) AS BIGINT) AS row_count,
          CASE max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) WHEN 1 THEN true WHEN 2 THEN false ELSE CAST(NULL AS BOOLEAN) END AS attested,
          CASE WHEN max(l_partkey) % 10 = 0 THEN '' WHEN max(l_partkey) % 10 = 1 THEN CAST(NULL AS VARCHAR(20)) ELSE 'h' || CAST(l_suppkey AS VARCHAR(19)) END AS host_at_settlement
        FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "raw_checks": f"""
        SELECT CAST(l_orderkey AS VARCHAR(20)) || '|' || CAST(l_suppkey AS VARCHAR(20)) || '|' || CAST(l_partkey AS VARCHAR(20)) || '|' || CAST(l_linenumber AS VARCHAR(20)) || '|' || CAST(US(l_shipdate) AS VARCHAR(20)) AS dedupe_key,
          l_orderkey AS promise_hash, l_suppkey AS validator, US(l_shipdate) AS scheduled_us, US(l_shipdate) + (l_partkey % 7) * 60000000 AS started_us,
          CASE l_partkey % 6 WHEN 0 THEN 'full' WHEN 1 THEN 'end' WHEN 2 THEN 'w1' WHEN 3 THEN 'w2' WHEN 4 THEN 'w3' ELSE 'enough' END AS label,
          {_outcome} AS outcome, l_partkey % 11 <> 0 AS assigned, l_returnflag = 'A' AS attested, l_returnflag = 'R' AND l_partkey % 2 = 0 AS attestation_unknown,
          l_partkey % 13 = 0 AS shadowed, l_partkey % 5 = 0 AS shadow_uncertain, l_partkey % 2 = 0 AS identity_stale, l_partkey % 3 = 0 AS subset_of_own, l_partkey % 97 = 0 AS pin_stale,
          l_partkey % 7 <> 3 AS rows_verify, l_partkey % 9 <> 4 AS tls_ok, l_partkey % 8 <> 5 AS tcp_ok, l_partkey % 17 = 0 AS attempt_owed,
          CAST(floor(l_quantity) AS BIGINT) AS rows_returned, l_partkey % 40 AS first_row, CAST(floor(l_extendedprice) AS BIGINT) % 3000 AS service_ms, CAST(floor(l_extendedprice * 100) AS BIGINT) AS bytes,
          CAST(floor(l_quantity) AS BIGINT) % 7 * 40 AS download_ms, l_orderkey % 20 = 0 AS match_waits, 'v' || CAST(l_linenumber % 3 AS VARCHAR(9)) AS vantage
        FROM lineitem""",
    "beats": """
        SELECT event_id AS seq, user_id AS validator, US(ts) AS at_us, event_type <> 'error' AND event_id % 4 <> 0 AS up,
          CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN 'expired' WHEN event_id % 6 = 2 THEN 'mismatch' ELSE 'verified' END AS identity,
          'h' || CAST(user_id % 20 AS VARCHAR(9)) AS host, 'v' || CAST(event_id % 2 AS VARCHAR(9)) AS vantage, CAST(floor(value) AS BIGINT) AS tcp_ms, props,
          CASE event_id % 7 WHEN 0 THEN 'not_serving' WHEN 1 THEN 'not_serving' WHEN 2 THEN 'serving' WHEN 3 THEN 'not_reported' WHEN 4 THEN 'unmeasured' ELSE '' END AS readiness
        FROM events""",
    "run_events": f"""
        SELECT 'c' || CAST(c_custkey % 3 AS VARCHAR(9)) AS component, 'v' || CAST(c_custkey % 2 AS VARCHAR(9)) AS vantage, c_custkey % 7 AS pid, {EPOCH} + c_custkey * 37 % 900 * {DAY} AS at_us, 'started' AS kind FROM customer
        UNION ALL SELECT 'c' || CAST(c_custkey % 3 AS VARCHAR(9)), 'v' || CAST(c_custkey % 2 AS VARCHAR(9)), c_custkey % 7, {EPOCH} + c_custkey * 37 % 900 * {DAY} + c_custkey % 5 * {6 * HOUR}, 'beat' FROM customer
        UNION ALL SELECT 'c' || CAST(c_custkey % 3 AS VARCHAR(9)), 'v' || CAST(c_custkey % 2 AS VARCHAR(9)), c_custkey % 7, {EPOCH} + c_custkey * 37 % 900 * {DAY} + c_custkey % 9 * {6 * HOUR}, 'stopped' FROM customer WHERE c_custkey % 40 = 0""",
    "payments": """
        SELECT CAST(o_orderkey AS VARCHAR(20)) AS dedupe_key, o_orderkey AS promise_hash, o_custkey AS publisher, US(o_orderdate) AS at_us,
          CASE o_orderkey % 8 WHEN 5 THEN 'timeout' WHEN 6 THEN 'deposit' WHEN 7 THEN 'withdrawal_executed' ELSE 'settlement' END AS kind,
          (o_orderkey * 37 % 4096) * 64 AS blob_size, CAST(floor(o_totalprice) AS BIGINT) % 500 AS amount, CASE WHEN o_orderkey % 12 = 0 THEN 'other' ELSE 'unit' END AS denom,
          'acc' || CAST(o_custkey % 5 AS VARCHAR(9)) AS processor, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'ns' || CAST(o_custkey % 17 AS VARCHAR(9)) END AS namespace
        FROM orders""",
    "escrow": "SELECT c_custkey AS publisher, c_custkey % 7 <> 0 AS found, CAST(floor(c_acctbal) AS BIGINT) AS balance, CASE WHEN c_custkey % 9 = 0 THEN 'other' ELSE 'unit' END AS denom FROM customer",
    "withdrawals": f"""
        SELECT c_custkey AS publisher, c_custkey * 3 AS requested_at, CAST(c_custkey % 400 AS BIGINT) AS amount, {EPOCH} + (c_custkey % 900) * {DAY} AS available_us, {EPOCH} + (c_custkey % 900 + c_custkey % 5 - 1) * {DAY} AS gone_us,
          c_custkey % 900 - 900 AS last_seen_height, c_custkey % 900 + 1500 AS gone_height FROM customer WHERE c_custkey % 4 <> 0""",
    "validators": """
        SELECT s_suppkey AS validator, CAST(floor(abs(s_acctbal)) AS BIGINT) + 1 AS power, 'm' || CAST(s_suppkey % 40 AS VARCHAR(9)) AS moniker, 'h' || CAST(s_suppkey AS VARCHAR(19)) AS host, n_name AS country, r_name AS provider,
          'as' || CAST(s_suppkey % 6 AS VARCHAR(9)) AS asn, 'c' || CAST(s_suppkey % 11 AS VARCHAR(9)) AS city, s_suppkey * 1009 % 200000 AS address
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "ranges": "SELECT p_partkey AS line, (p_partkey * 7919) % 200000 AS first, (p_partkey * 7919) % 200000 + (p_partkey % 40) * 50 AS last, p_partkey % 3 = 0 AS v6, 'as' || CAST(p_partkey % 30 AS VARCHAR(9)) AS asn FROM part",
    "params": "SELECT CAST(n_nationkey AS BIGINT) * 90 AS from_height, CAST(n_nationkey % 4 AS BIGINT) AS from_tx, CAST(20 + n_nationkey * 7 % 50 AS BIGINT) AS timeout_days, CAST(30 + n_nationkey * 11 % 40 AS BIGINT) AS retention_days FROM nation",
    "uncertain": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) * 90 AS from_height, CAST(n_nationkey AS BIGINT) * 90 + 15 AS to_height, n_nationkey % 3 = 0 AS holds, CAST(25 + n_nationkey AS BIGINT) AS retention_days FROM nation",
    "host_events": "SELECT c_custkey % 100 + 1 AS validator, c_custkey * 13 % 2400 AS height, c_custkey % 10 AS tx_index, CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'h' || CAST(c_custkey % 30 AS VARCHAR(9)) END AS host FROM customer",
    "scan_gaps": "SELECT CAST(r_regionkey AS BIGINT) * 400 + 120 AS first, CAST(r_regionkey AS BIGINT) * 400 + 150 AS last FROM region",
    "tx_costs": "SELECT o_custkey % 100 + 1 AS validator, (o_orderkey * 13) % 2400 AS height, o_orderkey % 10 AS tx_index, CAST(floor(o_totalprice) AS BIGINT) % 900 AS gas FROM orders",
    "amendments": "SELECT l_orderkey AS promise_hash, l_suppkey AS validator, US(l_shipdate) AS scheduled_us, max(CASE WHEN l_partkey % 2 = 0 THEN 'SHADOWED_SHARD' ELSE 'UNMATCHED_GENUINE' END) AS to_class FROM lineitem WHERE l_partkey % 31 = 0 GROUP BY l_orderkey, l_suppkey, US(l_shipdate)",
}


def _ready(text: str, engine: str) -> str:
    micros = r"unix_micros(CAST(\1 AS TIMESTAMP))" if engine == "spark" else r"epoch_us(\1)"
    text = re.sub(r"\bUS\((\w+)\)", micros, text)
    if engine == "spark":
        text = re.sub(r"VARCHAR\(\d+\)", "STRING", text).replace("//", "div")
    return text


def duckdb_views(sql: str) -> str:
    """``sql`` with the views it names, and those they name, as common table expressions in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in {**VIEWS, **DERIVED}.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(body.replace(f" {name} ", " "))
                if name not in needed:
                    needed.append(name)

    need(sql)
    views = ", ".join(f"{n} AS ({_ready({**VIEWS, **DERIVED}[n], 'duckdb')})" for n in needed)
    body = _ready(sql.strip(), "duckdb")
    if not views:
        return body
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"


#: Views that the SQL side derives by itself from others; Spark has operators for them.
DERIVED: dict[str, str] = {}


class Views:
    """The views of one folder of test tables, as DataFrames read on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._made = spark, folder, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            text = _ready(VIEWS[name], "spark")
            used = {t for t in TABLES if re.search(rf"\b{t}\b", text)}
            for t in used:
                text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
            self._made[name] = self.spark.sql(text, **{t: self.table(t) for t in used})
        return self._made[name]

    @cached_property
    def checks(self) -> DataFrame:
        """Classified checks, joined to what their promise says; see ``operators.checks``."""
        from tallyspan.operators.checks import classified

        return classified(self.raw_checks, self.publications, self.uncertain)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
