from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyspan.operators import failures
from tallyspan.sources import records

KINDS = {"MsgPay": "settlement", "MsgDeposit": "deposit", "MsgHost": "set_host"}


def lines(spark, rows):
    return records.parsed(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"), "failed_txs").where("not bad").select("record.*")


def message(index, kind, publisher="p", **more):
    return {"index": index, "type_url": f"/chain.module.v1.{kind}", "signer": f"s{index}", "detail": {"publisher": publisher}} | more


def test_reasons_and_failing_messages(spark):
    at = "failed to execute message; message index: 1: insufficient funds"
    two = [message(0, "MsgPay"), message(1, "MsgPay")]
    cases = [
        ("a", 10, "sdk", 5, at, two, "Insufficient funds", 1), ("b", 9, "sdk", 5, at, two, None, -1), ("c", 10, "sdk", 5, at, two[:1], "Insufficient funds", -1), ("d", 10, "undefined", 1, "x " + at, two, "The chain gave this error no code", -1),
        ("e", 10, "authz", 6, None, [], "Authorization expired", -1), ("f", 10, "own", 2, at.replace("1:", "01:"), two, "Own reason", -1), ("g", 10, "own", 3, at, None, None, -1),
    ]
    rows = lines(spark, [{"tx_hash": h, "app_version": v, "codespace": s, "code": c, "log": log, "messages": m} for h, v, s, c, log, m, _, _ in cases])
    found = {r.tx_hash: (r.reason, r.failed_index) for r in failures.explained(rows, {("own", 2): "Own reason"}).collect()}
    assert found == {h: (reason, index) for h, *_, reason, index in cases}
    assert len(failures.REASONS) == 50 and all(text[0].isupper() for text in failures.REASONS.values())


def test_kinds_and_lists(spark):
    rows = lines(spark, [
        {"tx_hash": "a", "ante_passed": True, "messages": [message(0, "MsgPay"), message(1, "MsgPay", "q"), message(2, "MsgOther")]},
        {"tx_hash": "b", "ante_passed": True, "messages": [message(0, "MsgPay"), message(1, "MsgHost")]},
        {"tx_hash": "c", "ante_passed": False, "messages": [message(0, "MsgDeposit")]},
        {"tx_hash": "d", "ante_passed": True, "messages": [message(0, "MsgDeposit", ""), message(1, "MsgDeposit", cut=True), {"index": 2, "type_url": "/x.MsgDeposit"}]},
        {"tx_hash": "e", "ante_passed": True, "messages": [message(0, "MsgOther")]},
    ])
    kinds = rows.select("tx_hash", failures.kind(F.transform("messages", lambda m: m["type_url"]), KINDS).alias("kind")).collect()
    assert {r.tx_hash: r.kind for r in kinds} == {"a": "settlement", "b": "several", "c": "deposit", "d": "deposit", "e": None}
    assert sorted(map(tuple, failures.listed(rows, KINDS, ["set_host"]).collect())) == [("a", "p", 0, "settlement"), ("a", "q", 1, "settlement"), ("b", "p", 0, "settlement"), ("b", "s1", 1, "set_host")]
