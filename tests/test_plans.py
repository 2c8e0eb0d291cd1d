"""Plans: filters reach the scan, few columns are read, no cartesian product, no Python where Columns do."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tallyspan.plans.catalog import QUERIES
from tallyspan.plans.views import Views
from tests.oracle import FOLDER

REPO = Path(__file__).resolve().parents[1]
PYTHON = {"row_assignment", "bech32_addresses", "resolved_addresses", "resolved_forms"}


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product_and_no_stray_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas", text)


def test_columns_are_pruned(spark):
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "market_hours"))
    assert scans and all({c.split(":")[0] for c in s.split(",")} <= {"o_orderkey", "o_orderdate", "o_totalprice"} for s in scans)


def test_filters_reach_the_scan(spark):
    """A bound on a key of a view is a bound on the column that it comes from."""
    rows = Views(spark, FOLDER).publications.where("promise_hash between 5 and 9").select("promise_hash", "blob_size")
    text = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(o_orderkey,5), LessThanOrEqual(o_orderkey,9)" in text
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["o_orderkey:bigint,o_totalprice:double"]


#: Headline queries: scans of the checks' table, and exchanges at most.
SHAPES = {
    "effective_class_tally": (1, 5), "rollup_classes": (1, 5), "obligations_by_validator": (1, 6), "obligations_network": (1, 6), "attestation": (1, 2), "service_time_quantiles": (1, 6),
    "counted_class": (1, 4), "load": (1, 4), "newest_endorsements": (2, 6),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_headline_queries_read_once_and_shuffle_little(spark, name):
    text = plan(spark, name)
    scans, exchanges = SHAPES[name]
    assert len(re.findall(r"Location: .*lineitem\.parquet", text)) <= scans
    assert len(re.findall(r"^\(\d+\) Exchange$", text, re.MULTILINE)) <= exchanges


def test_row_lists_are_shuffled_once(spark):
    """Checks with their row lists go through one exchange, by promise; no list is opened into rows or joined back."""
    text = plan(spark, "obligations_from_records")
    assert len(re.findall(r"^\(\d+\) Exchange$", text, re.MULTILINE)) <= 6
    assert len(re.findall(r"Location: .*lineitem\.parquet", text)) == 2


def test_building_plans_runs_no_job(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a job while a plan is built")

    for action in ("collect", "first", "head", "take", "count", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(spark.range(1)), action, refuse)
    for name in sorted(QUERIES):
        QUERIES[name](spark, FOLDER)


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    for name in ("tallyspan", "__spark_entry__.py"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tallyspan" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    for path in (REPO / "tallyspan").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tallyspan.llm" not in path.read_text()
