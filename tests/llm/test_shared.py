from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyspan.llm import shared


def test_written_tables_are_read_again_and_can_be_dropped(spark):
    one = shared.written(spark.range(5), "t")
    two = shared.written(spark.range(7), "t")
    assert (one.count(), two.count()) == (5, 7)
    shared.drop_written(one)
    with pytest.raises(Exception):  # noqa: B017  its files are gone
        spark.read.parquet(one.inputFiles()[0]).count()
    assert two.count() == 7


def test_words_and_loosened_keys(spark):
    rows = spark.createDataFrame([(" a\tb\n\x0b c\x0c\rd  ", 5), (None, -(2**63))], "t string, k long")
    found = rows.select(shared.words(F.col("t")).alias("w"), shared.loosened(F.col("k")).alias("k")).collect()
    assert found[0].w == ["a", "b", "c", "d"] and found[1].w == [] and [r.k for r in found] == [5, -(2**63)]


def test_scopes_drop_their_own_tables(spark):
    import os

    def there(frame):
        return os.path.exists(frame.inputFiles()[0].removeprefix("file://"))

    with shared.scope(spark) as outer:
        with shared.scope(spark) as inner:
            gone = shared.written(spark.range(3), "t")
            files = gone.inputFiles()
            kept = inner(gone.selectExpr("id + 1 as id"), "t")
        assert not os.path.exists(files[0].removeprefix("file://")) and there(kept) and kept.count() == 3
        result = outer(kept, "t")
        files = kept.inputFiles()
    assert not os.path.exists(files[0].removeprefix("file://")) and sorted(r.id for r in result.collect()) == [1, 2, 3]
