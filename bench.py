"""Times the headline queries on the tables of $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tallyspan.plans.catalog import QUERIES  # noqa: E402

HEADLINE = {
    "verdict_tally": "effective_class_tally",
    "attestation": "attestation",
    "obligations": "obligations_by_validator",
    "network_obligations": "obligations_network",
    "service_quantiles": "service_time_network",
    "validator_quantiles": "service_time_quantiles",
    "load": "load",
    "held_promises": "held_promises",
    "latest_answer": "latest_beat",
    "market_totals": "market_totals",
    "publishers": "publishers",
    "rollup_classes": "rollup_classes",
    "transitions": "reachability_transitions",
    "as_of_params": "params_as_of",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    settings = {"spark.sql.shuffle.partitions": cores, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, query in HEADLINE.items():
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[query](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(runs[1], 4)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
