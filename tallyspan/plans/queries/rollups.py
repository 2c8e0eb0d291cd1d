"""Queries of per-day partials, row assignment, sampling and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.functions import codecs
from tallyspan.operators import assignment as a
from tallyspan.operators import histories as h
from tallyspan.operators import obligations as obl
from tallyspan.operators import readings as read
from tallyspan.operators import rollups as r
from tallyspan.operators import sampling as s
from tallyspan.operators.checks import held_promises
from tallyspan.plans.derived import SUMS_SQL
from tallyspan.plans.registry import query
from tallyspan.plans.views import DAY, NOW, Views

FROM, TO = NOW - 500 * DAY + 7_200_000_000, NOW - 100 * DAY + 11


def _found(v: Views) -> DataFrame:
    return obl.obligations(obl.population(read.counted(v.checks), None, NOW), NOW)


@query("rollup_obligation_days", f"SELECT settled_us // {DAY} AS day, validator, {SUMS_SQL} FROM bucketed GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return r.obligation_days(_found(v))


@query("rollup_window", f"SELECT validator, {SUMS_SQL} FROM bucketed WHERE settled_us BETWEEN {FROM} AND {TO} GROUP BY validator")
def _(v: Views) -> DataFrame:
    found = _found(v)
    return r.over_window(r.obligation_days(found), found, FROM, TO, ["validator"])


@query("rollup_minus_excluded", f"SELECT {SUMS_SQL} FROM bucketed WHERE validator NOT IN (2, 4, 9)")
def _(v: Views) -> DataFrame:
    return r.merged_obligations(r.obligation_days(_found(v)), [], [2, 4, 9])


@query("rollup_classes", "SELECT validator, cls, count(*) AS n FROM checks GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return r.class_counts(v.checks, ["validator"])


@query("merged_class_days", "SELECT validator, cls, count(*) AS n FROM checks GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return r.merged_classes(r.class_days(v.checks), ["validator"])


@query("final_days", f"""WITH d AS (SELECT p.settled_us // {DAY} AS day, bool_and(p.must_serve_us <= {NOW} AND h.promise_hash IS NULL AND w.promise_hash IS NULL) AS final, count(*) AS promises FROM publications p
    LEFT JOIN held_promises h USING (promise_hash) LEFT JOIN (SELECT DISTINCT promise_hash FROM checks WHERE cls = 'PROBE_ERROR' AND shadow_uncertain AND match_waits) w USING (promise_hash) GROUP BY 1)
    SELECT *, bool_and(final) OVER (ORDER BY day) AS rolled FROM d""")
def _(v: Views) -> DataFrame:
    return _final_days(v, _waiting(v))


def _waiting(v: Views) -> DataFrame:
    return v.checks.where("cls = 'PROBE_ERROR' and shadow_uncertain and match_waits")


def _final_days(v: Views, waiting: DataFrame) -> DataFrame:
    return r.final_days(v.publications, held_promises(v.publications, v.uncertain), waiting, NOW)


def _days(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Day tables: before late rows came, refreshed for the days that they touched, and everything recomputed."""
    rows = v.checks.select("started_us", "validator", "cls", "promise_hash", "match_waits")
    early, late = rows.where("not match_waits"), rows.where("match_waits")
    stale = r.touched_days(late, "started_us")
    again = r.class_days(rows.withColumn("day", r.day_of(F.col("started_us"))).join(stale, "day", "left_semi"))
    kept = r.class_days(early)
    return kept, r.refreshed(kept, stale, again), r.class_days(rows)


@query("day_refresh", f"SELECT started_us // {DAY} AS day, validator, cls, count(*) AS n FROM checks GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return _days(v)[1].select("day", "validator", F.explode("classes").alias("cls", "n"))


@query("day_refresh_audit", f"""WITH k AS (SELECT started_us // {DAY} AS day, validator, string_agg(cls, ',' ORDER BY cls) AS c FROM checks WHERE NOT match_waits GROUP BY ALL), a AS (SELECT started_us // {DAY} AS day, validator, string_agg(cls, ',' ORDER BY cls) AS c FROM checks GROUP BY ALL)
    SELECT 'stale' AS part, 'kept' AS side, count(*) AS n FROM (SELECT * FROM k EXCEPT ALL SELECT * FROM a) UNION ALL SELECT 'stale', 'recomputed', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM k)""")
def _(v: Views) -> DataFrame:
    """The audit of the day tables against everything recomputed: before the refresh rows differ on both sides, after it none does."""

    def flat(days: DataFrame) -> DataFrame:
        return days.select("day", "validator", "checks", F.to_json("classes").alias("classes"))

    kept, refreshed, every = map(flat, _days(v))
    found = r.audit(kept, every).withColumn("part", F.lit("stale")).unionByName(r.audit(refreshed, every).withColumn("part", F.lit("refreshed")))
    return found.groupBy("part", "side").agg(F.count(F.lit(1)).alias("n"))


@query("read_plan", f"""WITH d AS (SELECT DISTINCT promise_hash FROM checks WHERE label IN ('end', 'full', 'enough') AND cls <> 'NOT_PROBED')
    SELECT CASE WHEN d.promise_hash IS NOT NULL THEN 'finished' WHEN must_serve_us - {NOW} > {90 * DAY} THEN 'later' WHEN must_serve_us > {NOW} THEN 'due' WHEN must_serve_us - {NOW} > -{300 * DAY} THEN 'missed' ELSE 'old' END AS state, count(*) AS n FROM publications LEFT JOIN d USING (promise_hash) GROUP BY 1""")
def _(v: Views) -> DataFrame:
    return r.read_plan(v.publications, v.checks, NOW, 90 * DAY, 300 * DAY).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _members(v: Views) -> DataFrame:
    blobs = v.publications.select("promise_hash", (F.col("needed_rows") + 10).alias("original"))
    return v.assignments.select("promise_hash", "validator").join(v.validators.select("validator", "power"), "validator").join(blobs.hint("merge"), "promise_hash")


@query("assigned_row_counts", """WITH m AS (SELECT a.promise_hash, validator, power, p.needed_rows + 10 AS original, sum(power) OVER (PARTITION BY a.promise_hash) AS total FROM assignments a JOIN validators USING (validator) JOIN publications p ON p.promise_hash = a.promise_hash),
    c AS (SELECT *, least(greatest((original * power * 3 + total - 1) // total, 2), original) AS row_count FROM m)
    SELECT promise_hash, validator, row_count::BIGINT AS row_count, coalesce(sum(row_count) OVER (PARTITION BY promise_hash ORDER BY power DESC, validator ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c""")
def _(v: Views) -> DataFrame:
    return a.counts(_members(v)).select("promise_hash", "validator", "row_count", "offset")


@query("row_assignment")
def _(v: Views) -> DataFrame:
    blobs = v.publications.select("promise_hash", "commitment", ((F.col("needed_rows") + 10) * 4).alias("total_rows"))
    return a.assign(_members(v), blobs).select("promise_hash", "validator", "row_count", F.array_join("rows", ",").alias("rows"))


def _decisions(v: Views) -> tuple[DataFrame, DataFrame]:
    chosen = v.publications.where("sampled_out").select(F.lit("v0").alias("vantage"), "promise_hash", "settled_us", "must_serve_us")
    step = F.expr("(must_serve_us - settled_us) div 4")
    points = chosen.select("vantage", "promise_hash", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.col("settled_us") + k * step)).alias("scheduled_us"))
    return chosen.select("vantage", "promise_hash"), points


@query("sampled_out_expansion", """SELECT p.promise_hash, a.validator, p.settled_us + k * ((p.must_serve_us - p.settled_us) // 4) AS scheduled_us, 'NOT_PROBED' AS cls FROM publications p JOIN assignments a ON a.promise_hash = p.promise_hash AND a.row_count > 0, (SELECT unnest([1, 2, 3]) AS k) WHERE p.sampled_out""")
def _(v: Views) -> DataFrame:
    return s.expanded(*_decisions(v), v.assignments).select("promise_hash", "validator", "scheduled_us", "cls")


@query("checks_with_expansion", """SELECT cls, count(*) AS n FROM (SELECT cls FROM checks UNION ALL SELECT 'NOT_PROBED' FROM publications p JOIN assignments a ON a.promise_hash = p.promise_hash AND a.row_count > 0, (SELECT unnest([1, 2, 3]) AS k) WHERE p.sampled_out) GROUP BY cls""")
def _(v: Views) -> DataFrame:
    rows = s.expanded(*_decisions(v), v.assignments)
    return s.with_expanded(v.checks, rows, ["promise_hash", "validator", "scheduled_us", "cls"]).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("collapsible_decisions", """WITH x AS (SELECT vantage, promise_hash, scheduled_us, list_sort(list(DISTINCT validator)) AS asked, count(*) AS n, min(outcome) AS o1, max(outcome) AS o2, bool_and(cls = 'NOT_PROBED') AS all_out FROM checks GROUP BY ALL)
    SELECT vantage, promise_hash, count(*) AS points, min(o1) AS reason FROM x GROUP BY vantage, promise_hash HAVING count(DISTINCT asked) = 1 AND bool_and(n = len(asked)) AND bool_and(all_out) AND min(o1) = max(o2)""")
def _(v: Views) -> DataFrame:
    return s.collapsible(v.checks)


@query("sampling_audit", f"""WITH d AS (SELECT settled_us // {DAY} AS day, promise_hash, promise_hash % 900 AS share, promise_hash % 3 = 0 AS probed FROM publications),
    k AS (SELECT day, 'secret' || day AS secret, CASE WHEN day % 13 = 0 THEN 'wrong' ELSE sha256('secret' || day) END AS commitment FROM (SELECT DISTINCT day FROM d)),
    c AS (SELECT d.*, k.*, ('0x' || substr(sha256(promise_hash || secret), 1, 16))::UBIGINT::HUGEINT * 1000 < 18446744073709551616::HUGEINT * share AS chosen FROM d JOIN k ON d.day = k.day)
    SELECT day, promise_hash, chosen, chosen = probed AS agrees, sha256(secret) = commitment AS secret_ok FROM c""")
def _(v: Views) -> DataFrame:
    decisions = v.publications.select(r.day_of(F.col("settled_us")).alias("day"), "promise_hash", (F.col("promise_hash") % 900).alias("share"), (F.col("promise_hash") % 3 == 0).alias("probed"))
    days = decisions.select("day").distinct()
    secret = F.concat(F.lit("secret"), F.col("day").cast("string"))
    secrets = days.select("day", secret.alias("secret"), F.when(F.col("day") % 13 == 0, "wrong").otherwise(F.sha2(secret, 256)).alias("commitment"))
    return s.audited(decisions, secrets)


@query("block_pace", """WITH a AS (SELECT min(settled_us) AS t0, max(settled_us) AS t1, min(height) AS h0, max(height) AS h1 FROM (SELECT settled_us, height FROM publications ORDER BY height DESC, tx_index DESC, promise_hash DESC LIMIT 600))
    SELECT h1 - h0 AS blocks, (t1 - t0) // greatest(h1 - h0, 1) AS pace_us, t1 + 100 * ((t1 - t0) // greatest(h1 - h0, 1)) AS eta_us FROM a""")
def _(v: Views) -> DataFrame:
    last = v.publications.orderBy(F.desc("height"), F.desc("tx_index"), F.desc("promise_hash")).limit(600)
    ends = last.agg(F.min("settled_us").alias("t0"), F.max("settled_us").alias("t1"), F.min("height").alias("h0"), F.max("height").alias("h1"))
    paced = ends.select((F.col("h1") - F.col("h0")).alias("blocks"), F.expr("(t1 - t0) div greatest(h1 - h0, 1)").alias("pace_us"), "t1")
    return paced.select("blocks", "pace_us", (F.col("t1") + 100 * F.col("pace_us")).alias("eta_us"))


@query("health_overdue", f"SELECT vantage, max(at_us) AS last_us, max(at_us) < max(max(at_us)) OVER () - 3 * 300000000 AS overdue FROM beats GROUP BY vantage")
def _(v: Views) -> DataFrame:
    from pyspark.sql import Window

    last = v.beats.groupBy("vantage").agg(F.max("at_us").alias("last_us"))
    newest = F.max("last_us").over(Window.partitionBy(F.lit(0)))  # a row a vantage
    return last.select("vantage", "last_us", (F.col("last_us") < newest - 3 * 300_000_000).alias("overdue"))


_SPANS = """WITH s AS (SELECT DISTINCT component, vantage, pid, at_us AS from_us FROM run_events WHERE kind = 'started'),
    n AS (SELECT *, lead(from_us) OVER (PARTITION BY component, vantage, pid ORDER BY from_us) AS next_us FROM s),
    t AS (SELECT n.*, (SELECT min(e.at_us) FROM run_events e WHERE e.kind = 'stopped' AND (e.component, e.vantage, e.pid) = (n.component, n.vantage, n.pid) AND e.at_us >= n.from_us) AS stop,
            (SELECT max(e.at_us) FROM run_events e WHERE e.kind = 'beat' AND (e.component, e.vantage, e.pid) = (n.component, n.vantage, n.pid) AND e.at_us >= n.from_us AND (n.next_us IS NULL OR e.at_us < n.next_us)) AS beat FROM n),
    r AS (SELECT component, vantage, pid, from_us, coalesce(stop, beat, from_us) AS to_us, stop IS NOT NULL AS stopped FROM t) """


@query("run_spans", _SPANS + "SELECT * FROM r")
def _(v: Views) -> DataFrame:
    return h.run_spans(v.run_events)


@query("gaps_outside_runs", _SPANS + """, m AS (SELECT component, from_us, max(to_us) OVER (PARTITION BY component ORDER BY from_us, to_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM r)
    SELECT component, upto AS from_us, from_us AS to_us FROM m WHERE from_us > upto""")
def _(v: Views) -> DataFrame:
    return h.gaps_between(h.run_spans(v.run_events), ["component"])


@query("json_fields", "SELECT validator, (props->>'$.k')::BIGINT AS k, count(*) AS n FROM beats WHERE json_valid(props) GROUP BY ALL")
def _(v: Views) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return v.beats.groupBy("validator", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("json_aggregate", """SELECT validator, '[' || string_agg('{"host":"' || host || '","n":' || n || '}', ',' ORDER BY host) || ']' AS hosts FROM (SELECT validator, host, count(*) AS n FROM host_events WHERE host <> '' GROUP BY ALL) GROUP BY validator""")
def _(v: Views) -> DataFrame:
    each = v.host_events.where("host <> ''").groupBy("validator", "host").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("validator").agg(F.to_json(F.array_sort(F.collect_list(F.struct("host", "n")))).alias("hosts"))


@query("message_kinds", """SELECT height, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'several' END AS kind FROM (SELECT (at_us - 788918400000000) // 86400000000 AS height, kind FROM payments) GROUP BY height""")
def _(v: Views) -> DataFrame:
    rows = v.payments.withColumn("height", F.expr(f"(at_us - 788918400000000) div {DAY}"))
    kinds = rows.groupBy("height").agg(F.array_distinct(F.collect_list("kind")).alias("kinds"))
    return kinds.select("height", F.when(F.size("kinds") == 1, F.element_at("kinds", 1)).otherwise("several").alias("kind"))


@query("signalled_power", """WITH s AS (SELECT validator, power, moniker, count(*) OVER (PARTITION BY moniker) AS shared FROM validators) SELECT round(sum(power) FILTER (validator % 3 = 0) / sum(power)::DOUBLE, 9) AS share, count(*) FILTER (validator % 3 = 0 AND shared = 1) AS named FROM s""")
def _(v: Views) -> DataFrame:
    shared = v.validators.groupBy("moniker").agg(F.count(F.lit(1)).alias("shared"))
    rows = v.validators.join(shared, "moniker")
    signal = F.col("validator") % 3 == 0
    return rows.agg(F.round(F.sum(F.when(signal, F.col("power"))) / F.sum("power"), 9).alias("share"), F.count_if(signal & (F.col("shared") == 1)).alias("named"))


@query("bech32_addresses")
def _(v: Views) -> DataFrame:
    key = F.substring(F.sha2(F.col("validator").cast("string"), 256), 1, 40)
    return v.validators.select("validator", key.alias("hex"), codecs.to_bech32("val")(key).alias("address")).withColumn("back", codecs.from_bech32(F.col("address")))
