"""Queries of classes, readings and obligations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.functions import rules
from tallyspan.operators import checks as over
from tallyspan.operators import facts
from tallyspan.operators import obligations as obl
from tallyspan.operators import readings as read
from tallyspan.operators import tallies
from tallyspan.plans.derived import SUMS_SQL
from tallyspan.plans.registry import query
from tallyspan.plans.views import DAY, NOW, Views
from tallyspan.sources import records, synthetic

WEEK = NOW - 7 * DAY


def _obligations(v: Views, start: int | None = None) -> DataFrame:
    return obl.obligations(obl.population(read.counted(v.checks), start, NOW), NOW)


@query("classification", "SELECT dedupe_key, outcome, phase, cls, held, verified FROM checks")
def _(v: Views) -> DataFrame:
    return v.checks.select("dedupe_key", "outcome", "phase", "cls", "held", "verified")


@query("phase_tally", "SELECT phase, cls, count(*) AS n FROM checks GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return v.checks.groupBy("phase", "cls").agg(F.count(F.lit(1)).alias("n"))


@query(
    "effective_class_tally",
    "SELECT validator, CASE WHEN held AND cls IN ('HEALTHY', 'FAULT') AND outcome <> 'INVALID_ROWS' THEN 'RETENTION_UNVERIFIED' ELSE cls END AS cls, count(*) AS n FROM checks WHERE assigned AND phase = 'in_window' GROUP BY ALL",
)
def _(v: Views) -> DataFrame:
    rows = v.checks.where("assigned and phase = 'in_window'").withColumn("cls", rules.effective(F.col("cls"), F.col("outcome"), F.col("held")))
    return rows.groupBy("validator", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("readings", "SELECT promise_hash, scheduled_us, lower, upper, have, ran, missed, asked, served, endorsers, answered, end_label, needed, available, unavailable FROM reading_states")
def _(v: Views) -> DataFrame:
    return read.readings(read.by_validator(v.checks)).drop("must_serve_us")


@query(
    "blob_status",
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY promise_hash ORDER BY CASE WHEN end_label THEN 0 WHEN endorsers > 0 AND answered >= endorsers THEN 1 ELSE 2 END, scheduled_us DESC) AS n
         FROM reading_states WHERE end_label OR answered > 0)
    SELECT promise_hash, scheduled_us, have, needed, CASE WHEN available THEN 'available' WHEN unavailable THEN 'unavailable' WHEN must_serve_us >= {NOW} THEN 'pending' ELSE 'not_read' END AS status FROM ranked WHERE n = 1""",
)
def _(v: Views) -> DataFrame:
    chosen = read.chosen_point(read.readings(read.by_validator(v.checks)))
    return read.blob_status(chosen, NOW).select("promise_hash", "scheduled_us", "have", "needed", "status")


@query(
    "blob_status_summary",
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY promise_hash ORDER BY CASE WHEN end_label THEN 0 WHEN endorsers > 0 AND answered >= endorsers THEN 1 ELSE 2 END, scheduled_us DESC) AS n
         FROM reading_states WHERE end_label OR answered > 0),
    newest AS (SELECT promise_hash FROM publications ORDER BY height DESC, tx_index DESC, promise_hash DESC LIMIT 500),
    found AS (SELECT promise_hash, CASE WHEN available THEN 'available' WHEN unavailable THEN 'unavailable' WHEN must_serve_us >= {NOW} THEN 'pending' ELSE 'not_read' END AS status FROM ranked WHERE n = 1)
    SELECT coalesce(status, 'not_read') AS status, count(*) AS n FROM newest LEFT JOIN found USING (promise_hash) GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    newest = v.publications.orderBy(F.desc("height"), F.desc("tx_index"), F.desc("promise_hash")).limit(500).select("promise_hash")
    found = read.blob_status(read.chosen_point(read.readings(read.by_validator(v.checks))), NOW).select("promise_hash", "status")
    return newest.join(found, "promise_hash", "left").groupBy(F.coalesce("status", F.lit("not_read")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("publisher_readings", """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY promise_hash ORDER BY CASE WHEN end_label THEN 0 WHEN endorsers > 0 AND answered >= endorsers THEN 1 ELSE 2 END, scheduled_us DESC) AS n
         FROM reading_states WHERE end_label OR answered > 0)
    SELECT publisher, count(*) AS readings, count(*) FILTER (available) AS available, count(*) FILTER (unavailable) AS unavailable FROM ranked JOIN publications USING (promise_hash) WHERE n = 1 GROUP BY publisher""")
def _(v: Views) -> DataFrame:
    chosen = read.chosen_point(read.readings(read.by_validator(v.checks))).join(v.publications.select("promise_hash", "publisher"), "promise_hash")
    return chosen.groupBy("publisher").agg(F.count(F.lit(1)).alias("readings"), F.count_if("available").alias("available"), F.count_if("unavailable").alias("unavailable"))


@query("counted_class", "SELECT dedupe_key, cls, counted FROM counted_checks")
def _(v: Views) -> DataFrame:
    return read.counted(v.checks).select("dedupe_key", "cls", "counted")


@query("obligations", "SELECT validator, promise_hash, faults, healthy, withheld, late_healthy, attempted, reached, last_cls, pending, coalesce(first_fault_us, -1) AS first_fault_us, bucket FROM bucketed")
def _(v: Views) -> DataFrame:
    return _obligations(v).drop("settled_us").withColumn("first_fault_us", F.coalesce("first_fault_us", F.lit(-1)))


@query("obligations_by_validator", f"SELECT validator, {SUMS_SQL} FROM bucketed GROUP BY validator")
def _(v: Views) -> DataFrame:
    return obl.sums(_obligations(v), ["validator"])


@query("obligations_network", f"SELECT {SUMS_SQL} FROM bucketed")
def _(v: Views) -> DataFrame:
    return obl.sums(_obligations(v), [])


_Z = "3.8416"


@query(
    "serve_rates",
    f"""WITH s AS (SELECT validator, {SUMS_SQL} FROM bucketed GROUP BY validator), n AS (SELECT validator, served AS num, served + broken AS den, broken FROM s),
    p AS (SELECT *, num / nullif(den, 0)::DOUBLE AS p, broken / nullif(den, 0)::DOUBLE AS q FROM n)
    SELECT validator, num, den, round(p, 9) AS rate, round((p + {_Z} / (2 * den) - 1.96 * sqrt(p * (1 - p) / den + {_Z} / (4.0 * den * den))) / (1 + {_Z} / den), 6) AS rate_low,
      round((q + {_Z} / (2 * den) + 1.96 * sqrt(q * (1 - q) / den + {_Z} / (4.0 * den * den))) / (1 + {_Z} / den), 6) AS fault_high,
      CASE WHEN den < 20 THEN 'unranked' WHEN p >= 0.98 THEN 'good' WHEN p >= 0.90 THEN 'warn' ELSE 'bad' END AS tone FROM p""",
)
def _(v: Views) -> DataFrame:
    rated = obl.rates(obl.sums(_obligations(v), ["validator"]))
    return rated.select("validator", "num", "den", "rate", "rate_low", "fault_high", rules.rate_tone(F.col("num") / F.nullif(F.col("den"), F.lit(0)), F.col("den")).alias("tone"))


@query("median_rate", f"WITH s AS (SELECT validator, {SUMS_SQL} FROM bucketed GROUP BY validator) SELECT round(median(served / (served + broken)::DOUBLE) FILTER (served + broken >= 20), 9) AS median_rate, sum(served)::BIGINT AS num, sum(served + broken)::BIGINT AS den FROM s")
def _(v: Views) -> DataFrame:
    s = obl.sums(_obligations(v), ["validator"]).withColumn("den", F.col("served") + F.col("broken"))
    rated = F.when(F.col("den") >= 20, F.col("served") / F.nullif(F.col("den"), F.lit(0)))
    return s.agg(F.round(F.percentile(rated, F.lit(0.5)), 9).alias("median_rate"), F.sum("served").alias("num"), F.sum("den").alias("den"))


@query("provisional_faults", f"SELECT validator, promise_hash, first_fault_us, first_fault_us > {NOW - 400 * DAY} AS provisional FROM bucketed WHERE bucket = 'broken'")
def _(v: Views) -> DataFrame:
    return obl.provisional(_obligations(v), NOW, 400 * DAY).select("validator", "promise_hash", "first_fault_us", "provisional")


@query("window_comparison", f"""WITH w AS (SELECT CASE WHEN settled_us >= {NOW - 180 * DAY} THEN 'this' ELSE 'previous' END AS part, * FROM bucketed WHERE settled_us >= {NOW - 360 * DAY})
    SELECT part, {SUMS_SQL} FROM w GROUP BY part""")
def _(v: Views) -> DataFrame:
    part = F.when(F.col("settled_us") >= NOW - 180 * DAY, "this").otherwise("previous")
    return obl.sums(_obligations(v, NOW - 360 * DAY).withColumn("part", part), ["part"])


@query("amended_classes", """SELECT c.dedupe_key, c.cls AS first_cls, coalesce(a.to_class, c.cls) AS cls FROM checks c LEFT JOIN amendments a ON a.promise_hash = c.promise_hash AND a.validator = c.validator AND a.scheduled_us = c.scheduled_us""")
def _(v: Views) -> DataFrame:
    return over.amended(v.checks, v.amendments).select("dedupe_key", "first_cls", "cls")


@query("corrected_deadlines", f"""SELECT p.promise_hash, p.must_serve_us AS was_us, least(p.must_serve_us, min(p.created_us + u.retention_days * {DAY})) AS must_serve_us FROM publications p
    LEFT JOIN uncertain u ON NOT u.holds AND p.promise_height - 1 <= u.to_height AND p.height >= u.from_height GROUP BY p.promise_hash, p.must_serve_us""")
def _(v: Views) -> DataFrame:
    return over.corrected(v.publications, v.uncertain, DAY).select("promise_hash", "was_us", "must_serve_us")


@query("held_promises", "SELECT promise_hash FROM held_promises")
def _(v: Views) -> DataFrame:
    return over.held_promises(v.publications, v.uncertain)


@query("obligations_from_records", f"SELECT validator, {SUMS_SQL} FROM bucketed GROUP BY validator")
def _(v: Views) -> DataFrame:
    """The same obligations from nothing but record lines: written as JSON, parsed, joined, classified and counted again."""
    said = records.parsed(synthetic.publication_lines(v.publications, v.assignments), "publications").where("not bad").select("record.*")
    made = records.parsed(synthetic.measurement_lines(v.raw_checks), "measurements").where("not bad").select("record.*")
    ranges = v.uncertain.select("from_height", "to_height", "holds")
    rows = over.classified(over.lean(facts.checks(made)), facts.publications(said), ranges)
    found = obl.obligations(obl.population(read.counted(rows), None, NOW), NOW)
    return obl.sums(found, ["validator"]).withColumn("validator", F.col("validator").cast("long"))


@query("load_from_records", f"""WITH e AS (SELECT a.validator, a.row_count FROM publications p JOIN assignments a ON a.promise_hash = p.promise_hash WHERE p.tx_code = 0 AND a.attested AND a.row_count > 0 AND p.settled_us <= {NOW})
    SELECT validator, count(*) AS promises, sum(row_count)::BIGINT AS rows FROM e GROUP BY validator""")
def _(v: Views) -> DataFrame:
    said = records.parsed(synthetic.publication_lines(v.publications, v.assignments), "publications").where("not bad").select("record.*")
    found = tallies.load(facts.publications(said), facts.assignments(said), 0, NOW, NOW)
    return found.where("promises > 0").select(F.col("validator").cast("long").alias("validator"), "promises", "rows")
