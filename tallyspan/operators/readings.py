"""Readings: all checks of a promise at one scheduled time, what they prove together, and what each check then counts as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions import rules

READING = ["promise_hash", "scheduled_us"]


def _c(name: str) -> Column:
    return F.col(name)


def _gains(checks: DataFrame) -> DataFrame:
    """Checks with ``__gain``: the rows that a verified answer adds to those of other answers of its reading.

    An answer is a stretch of row numbers (first_row, rows_returned), of which only what no earlier stretch has is a gain; or, with
    a column ``row_indices``, a list, where a row counts for the first check that has it. Either way the gains of a reading
    add up to the number of its distinct rows.
    """
    gave = _c("verified") & (_c("rows_returned") > 0)
    if "row_indices" in checks.columns:
        rows = checks.where(gave).select(*READING, "dedupe_key", F.explode("row_indices").alias("__row"))
        first = rows.groupBy(*READING, "__row").agg(F.min("dedupe_key").alias("dedupe_key"))
        counts = first.groupBy(*READING, "dedupe_key").agg(F.count(F.lit(1)).alias("__gain"))
        return checks.join(counts, [*READING, "dedupe_key"], "left").withColumn("__gain", F.coalesce("__gain", F.lit(0)))
    end = F.when(gave, _c("first_row") + _c("rows_returned"))
    before = Window.partitionBy(*READING).orderBy(F.when(gave, _c("first_row")), end).rowsBetween(Window.unboundedPreceding, -1)
    upto = checks.withColumn("__end", end).withColumn("__upto", F.max("__end").over(before))
    gain = F.when(gave, F.greatest(F.lit(0), _c("__end") - F.greatest(_c("first_row"), F.coalesce("__upto", _c("first_row")))))
    return upto.withColumn("__gain", F.coalesce(gain, F.lit(0))).drop("__end", "__upto")


def _owed(full: bool) -> Column:
    """Whether a check that was due in the window was not made, at a full reading or at any other."""
    of_full = rules.full_reading(_c("label"), _c("started_us"))
    return (_c("cls") == "NOT_PROBED") & _c("assigned") & (_c("phase") == "in_window") & (of_full if full else ~of_full)


def by_validator(checks: DataFrame) -> DataFrame:
    """One row per (reading, validator): what its answers there show."""
    reached = rules.reached(_c("verified"), _c("tcp_ok"), _c("outcome"))
    return _gains(checks).groupBy(*READING, "validator").agg(
        F.bool_or(_owed(full=False)).alias("missed_point"),
        F.bool_or(_owed(full=True)).alias("owed_full"),
        F.bool_or(_c("cls") != "NOT_PROBED").alias("other"),
        F.bool_or(~_c("cls").isin(*rules.GAPS)).alias("asked"),
        F.bool_or("verified").alias("gave"),
        F.bool_or(reached).alias("reached"),
        F.coalesce(F.max(F.when(_c("outcome") == "SERVED_OK", _c("rows_returned"))), F.lit(0)).alias("own_rows"),
        F.coalesce(F.sum(F.when(_c("verified"), _c("rows_returned"))), F.lit(0)).alias("rows"),
        F.sum("__gain").alias("gains"),
        F.bool_or(_c("assigned") & _c("attested") & (_c("phase") == "in_window")).alias("endorses"),
        F.bool_or((_c("phase") == "in_window") & reached).alias("reached_in_window"),
        F.bool_or(_c("label").isin(*rules.END_LABELS)).alias("end_label"),
        F.max("needed_rows").alias("needed_rows"),
        F.max("excess_rows").alias("excess_rows"),
        F.max("must_serve_us").alias("must_serve_us"),
    )


def readings(validators: DataFrame) -> DataFrame:
    """One row per reading: bounds on and number of distinct verified rows, whether it ran, missed a request, and its state."""
    out = validators.groupBy(*READING).agg(
        (F.sum("own_rows") - F.max("excess_rows")).alias("lower"),
        F.sum("rows").alias("upper"),
        F.sum("gains").cast("long").alias("have"),
        F.bool_or("reached").alias("ran"),
        F.bool_or(_c("missed_point") | (_c("owed_full") & ~_c("other"))).alias("missed"),
        F.count_if("asked").alias("asked"),
        F.count_if("gave").alias("served"),
        F.count_if("endorses").alias("endorsers"),
        F.count_if("reached_in_window").alias("answered"),
        F.bool_or("end_label").alias("end_label"),
        F.max("needed_rows").alias("needed"),
        F.max("must_serve_us").alias("must_serve_us"),
    )
    available = (_c("needed") > 0) & ((_c("lower") >= _c("needed")) | (_c("have") >= _c("needed")))
    out = out.withColumn("available", available)
    return out.withColumn("unavailable", (_c("needed") > 0) & ~_c("available") & _c("ran") & ~_c("missed"))


def chosen_point(found: DataFrame) -> DataFrame:
    """The reading that speaks for each promise: one with an end label, else the newest that every endorser answered,
    else the newest that anyone answered. Of several end readings the newest."""
    usable = found.where(_c("end_label") | (_c("answered") > 0))
    rank = F.when(_c("end_label"), 0).when((_c("endorsers") > 0) & (_c("answered") >= _c("endorsers")), 1).otherwise(2)
    order = Window.partitionBy("promise_hash").orderBy(rank, _c("scheduled_us").desc())
    return usable.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def blob_status(chosen: DataFrame, now: int) -> DataFrame:
    """available, unavailable, pending (window open) or not_read, for each chosen reading."""
    status = F.when(_c("available"), "available").when(_c("unavailable"), "unavailable").when(_c("must_serve_us") >= now, "pending").otherwise("not_read")
    return chosen.withColumn("status", status)


def counted(checks: DataFrame) -> DataFrame:
    """Checks with ``counted``: what each one counts as once its whole reading is known.

    Facts of readings come from all checks of any phase; filter afterwards. At a full reading a validator's own answers
    decide, at any other the state of the whole reading does. All facts are windows over one exchange by reading and
    two sorts of it, so the checks are read and classified once; a reading has at most a few checks of each validator. Row lists
    ride along in that exchange, and those of a reading are only put together where cheap bounds leave it open.
    """
    in_order = Window.partitionBy(*READING, "validator").orderBy("started_us")
    own, whole = Window.partitionBy(*READING, "validator"), Window.partitionBy(*READING)
    cls, outcome, verified = _c("cls"), _c("outcome"), _c("verified")
    foreign = rules.full_foreign(verified, outcome, cls, _c("subset_of_own"))
    marked = checks.withColumn("__first", F.row_number().over(in_order) == 1).withColumns({
        "__served": F.bool_or(rules.full_served(verified, outcome, cls)).over(own),
        "__blank": F.bool_or(cls.isin(*rules.GAPS) | foreign).over(own),
        "__newest_us": F.max("started_us").over(own),
        "__other": F.bool_or(cls != "NOT_PROBED").over(own),
        "__own_rows": F.coalesce(F.max(F.when(outcome == "SERVED_OK", _c("rows_returned"))).over(own), F.lit(0)),
    }).withColumns({
        "__lower": F.sum(F.when(_c("__first"), _c("__own_rows"))).over(whole) - _c("excess_rows"),
        "__ran": F.bool_or(rules.reached(verified, _c("tcp_ok"), outcome)).over(whole),
        "__missed": F.bool_or(_owed(full=False) | (_owed(full=True) & ~_c("__other"))).over(whole),
    })
    upper = F.sum(F.when(verified, _c("rows_returned"))).over(whole)
    undecided = (_c("needed_rows") > 0) & (_c("__lower") < _c("needed_rows")) & (_c("__upper") >= _c("needed_rows"))
    if "row_indices" in checks.columns:
        lists = F.when(verified & (_c("rows_returned") > 0) & undecided, _c("row_indices"))
        known = marked.withColumn("__upper", upper).withColumn("__have", F.size(F.array_distinct(F.flatten(F.collect_list(lists).over(whole)))))
    else:
        known = _gains(marked).withColumn("__have", F.sum("__gain").over(whole))
    available = (_c("__lower") >= _c("needed_rows")) | (_c("__have") >= _c("needed_rows"))
    unavailable = (_c("needed_rows") > 0) & ~available & _c("__ran") & ~_c("__missed")
    hold = _c("held") & (outcome != "INVALID_ROWS")
    yes = F.when(hold, "RETENTION_UNVERIFIED").otherwise("HEALTHY")
    no = F.when(hold, "RETENTION_UNVERIFIED").otherwise("FAULT")
    at_full = (
        F.when(rules.full_served(verified, outcome, cls), yes)
        .when(cls.isin(*rules.GAPS), cls)
        .when(foreign, "NOT_COUNTED")
        .when(_c("__served") | _c("__blank") | (_c("__newest_us") > _c("started_us")), "NOT_COUNTED")
        .when(~_c("__ran") | _c("attempt_owed"), "NOT_COUNTED")
        .otherwise(no)
    )
    at_point = F.when(verified, yes).when(cls == "NOT_PROBED", cls).when(unavailable, no).when(cls == "PROBE_ERROR", cls).otherwise("NOT_COUNTED")
    outside = (_c("phase") != "in_window") | ~_c("assigned") | ~_c("attested")
    value = F.when(outside, cls).when(rules.full_reading(_c("label"), _c("started_us")), at_full).otherwise(at_point)
    return known.withColumn("counted", value).select(*checks.columns, "counted")
