from __future__ import annotations

from tallyspan.operators import obligations as obl
from tallyspan.operators import readings as read
from tallyspan.plans.views import DAY
from tallyspan.sources import sinks, synthetic


def test_obligations_find_the_injected_truth(spark):
    pledged = synthetic.promises(spark, 200)
    rows, truth = synthetic.checks(pledged, 5, broken=0.2)
    now = 100 * DAY
    found = obl.sums(obl.obligations(obl.population(read.counted(rows), None, now), now), ["validator"])
    assert found.select("validator", "total", "broken", "served").exceptAll(truth).count() == 0 and truth.agg({"broken": "sum"}).first()[0] > 100
    again, _ = synthetic.checks(synthetic.promises(spark, 200), 5, broken=0.2)
    assert again.exceptAll(rows).count() == 0


def test_compaction_keeps_the_rows(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "id % 3 as day")
    rows.repartition(7).write.partitionBy("day").parquet(str(tmp_path / "a"))
    sinks.compact(spark, str(tmp_path / "a"), str(tmp_path / "b"), "day")
    again = spark.read.parquet(str(tmp_path / "b"))
    assert again.select("id", "day").exceptAll(rows.selectExpr("id", "cast(day as int)")).count() == 0 and len(list((tmp_path / "b").rglob("*.parquet"))) == 3
