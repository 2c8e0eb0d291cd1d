"""Queries of tallies, quantiles, signing, load and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.functions import rules
from tallyspan.operators import quantiles as q
from tallyspan.operators import tallies as t
from tallyspan.plans.registry import query
from tallyspan.plans.views import DAY, NOW, Views

JAN_2024 = 1_704_067_200_000_000
START = NOW - 700 * DAY


@query("class_tally_window", f"SELECT cls, count(*) AS n FROM checks WHERE started_us BETWEEN {START} AND {NOW} AND assigned AND phase = 'in_window' AND validator NOT IN (3, 5, 8) GROUP BY cls")
def _(v: Views) -> DataFrame:
    rows = t.without(t.window(v.checks, "started_us", START, NOW), "validator", [3, 5, 8])
    return rows.where("assigned and phase = 'in_window'").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("attestation", """SELECT validator, count(*) FILTER (a = 1) AS attested, count(*) FILTER (a = 0) AS not_attested, count(*) FILTER (a IS NULL) AS unknown
    FROM (SELECT validator, promise_hash, max(CAST(attested AS INTEGER)) AS a FROM assignments GROUP BY ALL) GROUP BY validator""")
def _(v: Views) -> DataFrame:
    return t.attestation(v.assignments)


@query("seen", "SELECT validator, count(*) AS checks, max(started_us) AS last_us, coalesce(max(started_us) FILTER (cls = 'HEALTHY'), -1) AS last_healthy_us FROM checks GROUP BY validator")
def _(v: Views) -> DataFrame:
    return t.seen(v.checks).withColumn("last_healthy_us", F.coalesce("last_healthy_us", F.lit(-1)))


@query("beats", """SELECT validator, count(*) AS beats, count(*) FILTER (up) AS up, count(*) FILTER (up AND identity = 'verified') AS identity_up,
    coalesce(max(at_us) FILTER (NOT up), -1) AS last_down_us, coalesce(max(at_us) FILTER (up), -1) AS last_up_us FROM beats GROUP BY validator""")
def _(v: Views) -> DataFrame:
    return t.beat_counts(v.beats).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("last_down_us", "last_up_us")})


@query("gaps_by_outcome", "SELECT outcome, cls, count(*) AS n, count(DISTINCT validator) AS validators FROM checks WHERE cls IN ('NOT_PROBED', 'PROBE_ERROR') GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return v.checks.where(F.col("cls").isin(*rules.GAPS)).groupBy("outcome", "cls").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("validator").alias("validators"))


@query("service_time_quantiles", """SELECT validator, count(*) AS n, max(service_ms) FILTER (k = (n + 1) // 2) AS p50, max(service_ms) FILTER (k = (95 * n + 99) // 100) AS p95
    FROM (SELECT validator, service_ms, row_number() OVER (PARTITION BY validator ORDER BY service_ms) AS k, count(*) OVER (PARTITION BY validator) AS n FROM checks WHERE verified) GROUP BY validator""")
def _(v: Views) -> DataFrame:
    return q.from_rows(v.checks.where("verified"), ["validator"], "service_ms", ["dedupe_key"], {"p50": 50, "p95": 95})


@query("service_time_network", """SELECT count(*) AS n, max(service_ms) FILTER (k = (n + 1) // 2) AS p50, max(service_ms) FILTER (k = (95 * n + 99) // 100) AS p95, max(service_ms) FILTER (k = (99 * n + 99) // 100) AS p99
    FROM (SELECT service_ms, row_number() OVER (ORDER BY service_ms) AS k, count(*) OVER () AS n FROM checks WHERE verified)""")
def _(v: Views) -> DataFrame:
    return q.from_histogram(q.histogram(v.checks.where("verified"), [], "service_ms"), [], "service_ms", {"p50": 50, "p95": 95, "p99": 99})


@query("service_time_two_pass", "SELECT max(service_ms) FILTER (k = (95 * n + 99) // 100) AS service_ms FROM (SELECT service_ms, row_number() OVER (ORDER BY service_ms) AS k, count(*) OVER () AS n FROM checks WHERE verified)")
def _(v: Views) -> DataFrame:
    return q.two_pass(q.histogram(v.checks.where("verified"), [], "service_ms"), "service_ms", 95)


@query("merged_day_quantiles", """SELECT validator, count(*) AS n, max(tcp_ms) FILTER (k = (n + 1) // 2) AS p50 FROM (SELECT validator, tcp_ms, row_number() OVER (PARTITION BY validator ORDER BY tcp_ms) AS k, count(*) OVER (PARTITION BY validator) AS n FROM beats) GROUP BY validator""")
def _(v: Views) -> DataFrame:
    days = q.histogram(v.beats.withColumn("day", F.floor(F.col("at_us") / DAY)), ["day", "validator"], "tcp_ms")
    return q.from_histogram(q.merged(days, ["validator"], "tcp_ms"), ["validator"], "tcp_ms", {"p50": 50})


@query("throughput_median", """WITH e AS (SELECT validator, bytes // download_ms AS rate FROM checks WHERE verified AND bytes >= 2097152 AND download_ms > 0),
    r AS (SELECT validator, rate, row_number() OVER (PARTITION BY validator ORDER BY rate) AS k, count(*) OVER (PARTITION BY validator) AS n FROM e) SELECT validator, n, max(rate) AS rate FROM r WHERE k = (n + 1) // 2 GROUP BY ALL""")
def _(v: Views) -> DataFrame:
    rows = v.checks.where("verified and bytes >= 2097152 and download_ms > 0").withColumn("rate", F.expr("bytes div download_ms"))
    return q.lower_median(rows, ["validator"], "rate")


@query("value_histogram", "SELECT validator, tcp_ms, count(*) AS n FROM beats GROUP BY ALL")
def _(v: Views) -> DataFrame:
    return q.histogram(v.beats, ["validator"], "tcp_ms")


@query("signing_participation", """SELECT validator, count(*) FILTER (attested IS NOT NULL AND host_at_settlement IS DISTINCT FROM '') AS known, count(*) FILTER (attested AND host_at_settlement IS DISTINCT FROM '') AS signed,
    count(*) FILTER (attested IS NULL AND host_at_settlement IS DISTINCT FROM '') AS unknown, count(*) FILTER (host_at_settlement = '') AS no_host FROM publications JOIN assignments USING (promise_hash) WHERE tx_code = 0 AND row_count > 0 GROUP BY validator""")
def _(v: Views) -> DataFrame:
    return t.signing(v.publications, v.assignments)


@query("quorum_distribution", """WITH e AS (SELECT promise_hash, sum(power) AS total, sum(CASE WHEN attested THEN power ELSE 0 END) AS signed FROM publications JOIN assignments USING (promise_hash) JOIN validators USING (validator) WHERE tx_code = 0 GROUP BY promise_hash)
    SELECT CASE WHEN signed >= total THEN 'all' WHEN signed * 10 >= total * 9 THEN '90%' WHEN signed * 4 >= total * 3 THEN '75%' WHEN signed * 3 >= total * 2 THEN '67%' ELSE 'less' END AS edge, count(*) AS n FROM e GROUP BY 1""")
def _(v: Views) -> DataFrame:
    return t.quorum(v.publications, v.assignments, v.validators.select("validator", "power"))


@query("newest_endorsements", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY validator ORDER BY height DESC, tx_index DESC, promise_hash DESC) AS k FROM publications JOIN assignments USING (promise_hash) WHERE row_count > 0)
    SELECT validator, count(*) FILTER (k <= 20) AS newest, count(*) FILTER (k <= 20 AND attested) AS newest_signed, coalesce(arg_min(promise_hash, k) FILTER (attested), -1) AS last_signed FROM r GROUP BY validator""")
def _(v: Views) -> DataFrame:
    return t.newest_endorsements(v.publications, v.assignments).withColumn("last_signed", F.coalesce("last_signed", F.lit(-1)))


LOAD_FROM = NOW - 900 * DAY


@query("load", f"""WITH e AS (SELECT a.validator, a.row_count, a.row_count * p.blob_size AS b, nullif(greatest(p.needed_rows, 0), 0) AS d, p.settled_us >= {LOAD_FROM} AND p.settled_us <= {NOW} AS i, p.must_serve_us > {NOW} AND p.settled_us <= {NOW} AS h
      FROM publications p JOIN assignments a ON a.promise_hash = p.promise_hash WHERE p.tx_code = 0 AND a.attested AND a.row_count > 0),
    s AS (SELECT validator, d, count(*) FILTER (i) AS n, sum(row_count) FILTER (i) AS r, coalesce(sum(b) FILTER (i), 0)::BIGINT AS x, coalesce(sum(b) FILTER (h), 0)::BIGINT AS y FROM e WHERE i OR h GROUP BY ALL)
    SELECT validator, sum(n)::BIGINT AS promises, coalesce(sum(r), 0)::BIGINT AS rows, (coalesce(sum(x // d), 0) + coalesce(floor(round(sum((x % d) / d::DOUBLE), 9)), 0))::BIGINT AS load_bytes,
      (coalesce(sum(y // d), 0) + coalesce(floor(round(sum((y % d) / d::DOUBLE), 9)), 0))::BIGINT AS held_bytes FROM s GROUP BY validator""")
def _(v: Views) -> DataFrame:
    return t.load(v.publications, v.assignments, LOAD_FROM, NOW, NOW)


@query("load_bands", "SELECT CASE WHEN n <= 148 THEN 'floor' WHEN n < 1024 THEN 'low' WHEN n < 2731 THEN 'mid' ELSE 'high' END AS band, count(*) AS validators FROM (SELECT validator, promise_hash // 2500, sum(row_count) // 2 AS n FROM assignments GROUP BY 1, 2) GROUP BY 1")
def _(v: Views) -> DataFrame:
    rows = v.assignments.groupBy("validator", F.expr("promise_hash div 2500")).agg(F.expr("sum(row_count) div 2").alias("n"))
    return rows.groupBy(rules.load_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("validators"))


@query("retained_promises", f"SELECT validator, count(*) AS promises, sum(row_count)::BIGINT AS rows FROM publications JOIN assignments USING (promise_hash) WHERE settled_us <= {NOW} AND must_serve_us > {NOW} AND row_count > 0 GROUP BY validator")
def _(v: Views) -> DataFrame:
    return t.retained(v.publications, v.assignments, NOW)


@query("readiness", """WITH r AS (SELECT validator, at_us, up AND identity = 'verified' AS ok, CASE WHEN up AND identity = 'verified' THEN readiness ELSE '' END AS said, row_number() OVER (PARTITION BY validator ORDER BY at_us DESC, seq DESC) AS k FROM beats),
    a AS (SELECT validator, list(said ORDER BY k) AS said, list(at_us ORDER BY k) AS ats, list(ok ORDER BY k) AS ok FROM r WHERE k <= 4 GROUP BY validator),
    b AS (SELECT validator, ats[1] AS checked_us, ok[1] AS ok, said[1] AS says, list_filter(said[2:], lambda x: x <> 'unmeasured')[1] AS was, list_filter(said[2:], lambda x: x IN ('serving', 'not_serving', 'not_reported'))[1] AS answer FROM a WHERE list_bool_or(list_transform(said, lambda x: x <> ''))),
    w AS (SELECT *, CASE says WHEN 'serving' THEN 'ready' WHEN 'not_reported' THEN 'not_reported' WHEN 'not_serving' THEN CASE WHEN was = 'not_serving' THEN 'not_ready' ELSE 'not_ready_once' END WHEN 'unmeasured' THEN 'unchecked' ELSE CASE WHEN ok THEN NULL ELSE 'unchecked' END END AS word FROM b)
    SELECT validator, word, checked_us, coalesce(CASE WHEN word = 'unchecked' THEN CASE answer WHEN 'serving' THEN 'ready' WHEN 'not_serving' THEN 'not_ready' ELSE answer END END, '') AS last_answer FROM w WHERE word IS NOT NULL""")
def _(v: Views) -> DataFrame:
    return t.readiness(v.beats).withColumn("last_answer", F.coalesce("last_answer", F.lit("")))


_SHARES = "SELECT dimension, key, count(*) AS hosts, sum(power)::BIGINT AS stake FROM (" + " UNION ALL ".join(f"SELECT power, '{d}' AS dimension, {d} AS key FROM validators" for d in ("provider", "country", "asn", "city")) + ") GROUP BY ALL"


@query("hosting_concentration", f"WITH s AS ({_SHARES}) SELECT *, sum(hosts) OVER (PARTITION BY dimension)::BIGINT AS all_hosts, sum(stake) OVER (PARTITION BY dimension)::BIGINT AS all_stake FROM s")
def _(v: Views) -> DataFrame:
    return t.concentration(v.validators, ["provider", "country", "asn", "city"])


@query("concentration_coefficient", f"""WITH s AS ({_SHARES}), r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY stake DESC, key) AS k, sum(stake) OVER (PARTITION BY dimension ORDER BY stake DESC, key ROWS UNBOUNDED PRECEDING) AS upto, sum(stake) OVER (PARTITION BY dimension) AS whole FROM s)
    SELECT dimension, min(k) FILTER (upto * 3 > whole) AS n FROM r GROUP BY dimension""")
def _(v: Views) -> DataFrame:
    return t.coefficient(t.concentration(v.validators, ["provider", "country", "asn", "city"]))


@query("latest_beat", "SELECT validator, at_us, up, identity FROM (SELECT *, row_number() OVER (PARTITION BY validator ORDER BY at_us DESC, seq DESC) AS k FROM beats) WHERE k = 1")
def _(v: Views) -> DataFrame:
    return t.latest(v.beats, ["validator"], [F.desc("at_us"), F.desc("seq")]).select("validator", "at_us", "up", "identity")


@query("identity_census", "SELECT CASE WHEN NOT up THEN 'down' WHEN identity = '' THEN 'unjudged' ELSE identity END AS status, count(*) AS validators FROM (SELECT *, row_number() OVER (PARTITION BY validator ORDER BY at_us DESC, seq DESC) AS k FROM beats) WHERE k = 1 GROUP BY 1")
def _(v: Views) -> DataFrame:
    newest = t.latest(v.beats, ["validator"], [F.desc("at_us"), F.desc("seq")])
    status = F.when(~F.col("up"), "down").when(F.col("identity") == "", "unjudged").otherwise(F.col("identity"))
    return newest.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("validators"))


@query("shared_names", "SELECT moniker, count(*) AS n, string_agg(CAST(validator AS VARCHAR), ',' ORDER BY validator) AS validators FROM validators GROUP BY moniker HAVING count(*) > 1")
def _(v: Views) -> DataFrame:
    found = v.validators.groupBy("moniker").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("validator")), ",").alias("validators"))
    return found.where("n > 1")


@query("row_counts", "SELECT 'publications' AS name, count(*) AS n FROM publications UNION ALL SELECT 'assignments', count(*) FROM assignments UNION ALL SELECT 'checks', count(*) FROM raw_checks UNION ALL SELECT 'beats', count(*) FROM beats UNION ALL SELECT 'payments', count(*) FROM payments")
def _(v: Views) -> DataFrame:
    parts = [getattr(v, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit("checks" if n == "raw_checks" else n).alias("name"), "n") for n in ("publications", "assignments", "raw_checks", "beats", "payments")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("first_events", "SELECT validator, started_us, promise_hash FROM (SELECT *, row_number() OVER (PARTITION BY validator ORDER BY started_us, promise_hash, dedupe_key) AS k FROM checks WHERE cls = 'HEALTHY') WHERE k = 1")
def _(v: Views) -> DataFrame:
    return t.latest(v.checks.where("cls = 'HEALTHY'"), ["validator"], [F.col("started_us"), F.col("promise_hash"), F.col("dedupe_key")]).select("validator", "started_us", "promise_hash")


@query("vantage_recent", f"SELECT vantage, max(at_us) AS last_us, max(at_us) >= {JAN_2024 + 29 * DAY} AS recent, count(DISTINCT validator) AS validators FROM beats GROUP BY vantage")
def _(v: Views) -> DataFrame:
    return v.beats.groupBy("vantage").agg(F.max("at_us").alias("last_us"), (F.max("at_us") >= JAN_2024 + 29 * DAY).alias("recent"), F.count_distinct("validator").alias("validators"))


@query("refused_minutes", "SELECT at_us // 60000000 AS minute, count(*) AS beats, count(*) FILTER (NOT up) AS refused FROM beats GROUP BY 1 HAVING count(*) FILTER (NOT up) > 0")
def _(v: Views) -> DataFrame:
    found = v.beats.groupBy(F.floor(F.col("at_us") / 60_000_000).cast("long").alias("minute")).agg(F.count(F.lit(1)).alias("beats"), F.count_if(~F.col("up")).alias("refused"))
    return found.where("refused > 0")


@query("waits_p95_hourly", """SELECT hour, count(*) AS n, max(tcp_ms) FILTER (k = (95 * n + 99) // 100) AS p95 FROM (SELECT at_us // 3600000000 AS hour, tcp_ms, row_number() OVER (PARTITION BY at_us // 3600000000 ORDER BY tcp_ms) AS k, count(*) OVER (PARTITION BY at_us // 3600000000) AS n FROM beats) GROUP BY hour""")
def _(v: Views) -> DataFrame:
    rows = v.beats.withColumn("hour", F.floor(F.col("at_us") / 3_600_000_000).cast("long"))
    return q.from_histogram(q.histogram(rows, ["hour"], "tcp_ms"), ["hour"], "tcp_ms", {"p95": 95})
