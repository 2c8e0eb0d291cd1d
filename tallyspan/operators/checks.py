"""Checks with their phase, class and hold; overlays of amendments and corrections over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions import rules
from tallyspan.operators.ranges import overlapping
from tallyspan.plans.views import TOLERANCE


def held_promises(publications: DataFrame, uncertain: DataFrame) -> DataFrame:
    """promise_hash of every promise whose heights meet a range that still holds verdicts."""
    spans = publications.select("promise_hash", (F.col("promise_height") - 1).alias("lo"), F.col("height").alias("hi"))
    open_ranges = uncertain.where("holds").select(F.col("from_height").alias("lo"), F.col("to_height").alias("hi"))
    return overlapping(spans, open_ranges, "promise_hash")


def with_held(publications: DataFrame, uncertain: DataFrame, keep: list[str], width: int = 64) -> DataFrame:
    """promise_hash, ``keep`` and ``held``: whether the promise's heights meet a range that still holds verdicts.

    One shuffle by promise, which a join with its checks can use again. Ranges are cut at buckets of ``width`` heights, so a
    bucket has at most width * (width + 1) / 2 different ones; a promise's heights lie in few buckets.
    """
    first, last = F.col("__b") * width, F.col("__b") * width + width - 1
    cut = uncertain.where("holds").select("from_height", "to_height", F.explode(F.sequence(F.floor(F.col("from_height") / width), F.floor(F.col("to_height") / width))).alias("__b"))
    cut = cut.select("__b", F.greatest("from_height", first).alias("__from"), F.least("to_height", last).alias("__to")).distinct()
    lo, hi = F.col("promise_height") - 1, F.col("height")
    spans = publications.select("promise_hash", *keep, lo.alias("__lo"), hi.alias("__hi"), F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))).alias("__c"))
    meets = (F.col("__b") == F.col("__c")) & (F.col("__from") <= F.col("__hi")) & (F.col("__to") >= F.col("__lo"))
    joined = spans.join(cut, meets, "left")
    return joined.groupBy("promise_hash").agg(*[F.max(c).alias(c) for c in keep], F.max(F.col("__b").isNotNull()).alias("held"))


def evidence() -> dict[str, Column]:
    names = ("assigned", "attested", "attestation_unknown", "verified", "shadowed", "shadow_uncertain", "identity_stale", "pin_stale")
    return {n: F.col(n) for n in names}


def decided_us(must_serve: Column) -> Column:
    """The moment that a check's phase is taken at: its start, or the slot of one that was never made. A shard that was not
    found in the window is judged by the end of the answer and a guard, wider by what the clock is behind, so that a
    deadline that passed meanwhile is not held against the endpoint."""
    guarded = F.col("finished_us") + rules.NOT_FOUND_GUARD_US + F.col("behind_us")
    missing = (F.col("outcome") == "NOT_FOUND") & (F.col("started_us") < must_serve)
    return F.when(F.col("outcome") == "MISSED", F.col("scheduled_us")).when(missing, F.greatest(F.col("started_us"), guarded)).otherwise(F.col("started_us"))


def verified() -> Column:
    """Whether an answer's rows were proved to be of the blob."""
    return (F.col("outcome") == "SERVED_OK") | (F.col("outcome").isin("WRONG_ROWS", "PARTIAL") & F.col("rows_verify"))


def lean(raw: DataFrame) -> DataFrame:
    """Raw checks without the row lists that no reading looks into, those of answers that are not verified: they need not be shuffled."""
    return raw.withColumn("row_indices", F.when(verified(), F.col("row_indices")))


def classified(raw: DataFrame, publications: DataFrame, uncertain: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Raw checks with what their promise says (settled_us, must_serve_us, ...), ``verified``, ``phase``, ``cls`` and ``held``.

    The phase is that of the start, or of ``decided_us`` where the checks say when they finished.
    """
    promised = with_held(publications, uncertain, ["settled_us", "must_serve_us", "needed_rows", "excess_rows", "height", "tx_index", "commitment"])
    joined = raw.join(promised, "promise_hash").withColumn("verified", verified())
    at = decided_us(F.col("must_serve_us")) if "finished_us" in raw.columns else F.col("started_us")
    joined = joined.withColumn("phase", rules.phase(at, F.col("must_serve_us"), tolerance))
    return joined.withColumn("cls", rules.classification(F.col("outcome"), F.col("phase"), evidence()))


def amended(checks: DataFrame, amendments: DataFrame) -> DataFrame:
    """Checks with late verdicts laid over them: ``cls`` is the amended class, ``first_cls`` the recorded one.

    Facts stay as they were written; an amendment names a promise, a validator and a scheduled time.
    """
    late = amendments.select("promise_hash", "validator", "scheduled_us", F.col("to_class").alias("__to"))
    joined = checks.join(late, ["promise_hash", "validator", "scheduled_us"], "left")
    return joined.withColumn("first_cls", F.col("cls")).withColumn("cls", F.coalesce("__to", "cls")).drop("__to")


def corrected(publications: DataFrame, uncertain: DataFrame, day: int) -> DataFrame:
    """Deadlines after verified ranges: only ever earlier than recorded; ``was_us`` keeps the recorded one."""
    spans = publications.select("promise_hash", (F.col("promise_height") - 1).alias("lo"), F.col("height").alias("hi"))
    known = uncertain.where("not holds").select(F.col("from_height").alias("lo"), F.col("to_height").alias("hi"), "retention_days")
    found = overlapping(spans, known, "promise_hash", keep="retention_days").groupBy("promise_hash").agg(F.min("retention_days").alias("days"))
    joined = publications.join(found, "promise_hash", "left")
    earlier = F.least(F.col("must_serve_us"), F.col("created_us") + F.col("days") * day)  # least skips a null
    return joined.withColumn("was_us", F.col("must_serve_us")).withColumn("must_serve_us", earlier).drop("days")
