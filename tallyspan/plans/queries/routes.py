"""Queries that answer a whole question, from several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.functions import codecs
from tallyspan.operators import market as m
from tallyspan.operators import obligations as obl
from tallyspan.operators import quantiles as q
from tallyspan.operators import ranges as r
from tallyspan.operators import readings as read
from tallyspan.operators import routes as route
from tallyspan.operators import tallies as t
from tallyspan.plans.derived import SUMS_SQL
from tallyspan.plans.registry import query
from tallyspan.plans.views import DAY, EPOCH, NOW, Views

MONTH = route.named_span("30d", NOW)
_POINT = """SELECT promise_hash, CASE WHEN available THEN 'available' WHEN unavailable THEN 'unavailable' WHEN must_serve_us >= {now} THEN 'pending' ELSE 'not_read' END AS status FROM
    (SELECT *, row_number() OVER (PARTITION BY promise_hash ORDER BY CASE WHEN end_label THEN 0 WHEN endorsers > 0 AND answered >= endorsers THEN 1 ELSE 2 END, scheduled_us DESC) AS n FROM reading_states WHERE end_label OR answered > 0) WHERE n = 1""".format(now=NOW)


def _tallies(v: Views) -> DataFrame:
    return obl.sums(obl.obligations(obl.population(read.counted(v.checks), None, NOW), NOW), ["validator"])


@query("route_validators", f"""WITH o AS (SELECT validator, {SUMS_SQL} FROM bucketed GROUP BY validator), b AS (SELECT validator, count(*) AS beats, count(*) FILTER (up) AS up FROM beats GROUP BY validator),
    s AS (SELECT validator, count(*) FILTER (attested AND host_at_settlement IS DISTINCT FROM '') AS signed, count(*) FILTER (attested IS NOT NULL AND host_at_settlement IS DISTINCT FROM '') AS known FROM publications JOIN assignments USING (promise_hash) WHERE tx_code = 0 AND row_count > 0 GROUP BY validator),
    l AS (SELECT validator, max(service_ms) FILTER (k = (n + 1) // 2) AS p50 FROM (SELECT validator, service_ms, row_number() OVER (PARTITION BY validator ORDER BY service_ms) AS k, count(*) OVER (PARTITION BY validator) AS n FROM checks WHERE verified) GROUP BY validator)
    SELECT validator, power, moniker, coalesce(served, 0) AS served, coalesce(broken, 0) AS broken, coalesce(total, 0) AS total, coalesce(beats, 0) AS beats, coalesce(up, 0) AS up, coalesce(signed, 0) AS signed, coalesce(known, 0) AS known, coalesce(p50, -1) AS p50
    FROM validators LEFT JOIN o USING (validator) LEFT JOIN b USING (validator) LEFT JOIN s USING (validator) LEFT JOIN l USING (validator)""")
def _(v: Views) -> DataFrame:
    times = q.from_histogram(q.histogram(v.checks.where("verified"), ["validator"], "service_ms"), ["validator"], "service_ms", {"p50": 50})
    return route.validators(v.validators, _tallies(v), v.beats, t.signing(v.publications, v.assignments), times)


@query("route_network", f"""WITH o AS (SELECT {SUMS_SQL} FROM bucketed), l AS (SELECT max(n) AS verified, max(service_ms) FILTER (k = (n + 1) // 2) AS p50, max(service_ms) FILTER (k = (95 * n + 99) // 100) AS p95 FROM (SELECT service_ms, row_number() OVER (ORDER BY service_ms) AS k, count(*) OVER () AS n FROM checks WHERE verified)),
    b AS (SELECT count(*) FILTER (up) AS up, count(*) AS known FROM (SELECT *, row_number() OVER (PARTITION BY validator ORDER BY at_us DESC, seq DESC) AS k FROM beats) WHERE k = 1)
    SELECT o.served, o.broken, o.total, l.verified, l.p50, l.p95, b.up, b.known FROM o, l, b""")
def _(v: Views) -> DataFrame:
    return route.network(_tallies(v), v.checks, v.beats)


@query("route_blobs", f"""WITH p AS (SELECT * FROM publications WHERE namespace = 'ns5' ORDER BY height DESC, tx_index DESC, promise_hash DESC LIMIT 201), s AS ({_POINT}), c AS (SELECT promise_hash, sum(amount) FILTER (kind = 'settlement') AS settled FROM payments WHERE kind IN ('settlement', 'timeout') GROUP BY 1)
    SELECT promise_hash, height, coalesce(status, 'not_read') AS status, coalesce(settled, 0)::BIGINT AS settled FROM p LEFT JOIN s USING (promise_hash) LEFT JOIN c USING (promise_hash)""")
def _(v: Views) -> DataFrame:
    statuses = read.blob_status(read.chosen_point(read.readings(read.by_validator(v.checks))), NOW)
    return route.blobs_page(v.publications, statuses, m.charges(v.payments), (1 << 40, 0, 0), 200, equal={"namespace": "ns5"})


@query("route_blob_services", """SELECT promise_hash, validator, CASE counted WHEN 'HEALTHY' THEN 'served' WHEN 'FAULT' THEN 'not served' WHEN 'RETENTION_UNVERIFIED' THEN 'withheld' WHEN 'NOT_PROBED' THEN 'not read' WHEN 'PROBE_ERROR' THEN 'not read' ELSE 'not counted' END AS word FROM
    (SELECT *, row_number() OVER (PARTITION BY promise_hash, validator ORDER BY scheduled_us DESC, started_us DESC, dedupe_key DESC) AS k FROM counted_checks) WHERE k = 1""")
def _(v: Views) -> DataFrame:
    last = t.latest(read.counted(v.checks), ["promise_hash", "validator"], [F.desc("scheduled_us"), F.desc("started_us"), F.desc("dedupe_key")])
    return last.select("promise_hash", "validator", route.service_word(F.col("counted")).alias("word"))


@query("route_checks", f"SELECT dedupe_key, cls, counted FROM counted_checks WHERE started_us BETWEEN {MONTH.start} AND {MONTH.end} AND counted = 'FAULT' ORDER BY started_us DESC, dedupe_key DESC LIMIT 300")
def _(v: Views) -> DataFrame:
    return route.checks_page(read.counted(v.checks), MONTH, 300, not_served=True).select("dedupe_key", "cls", "counted")


@query("route_validator_checks", "SELECT dedupe_key, cls FROM counted_checks WHERE validator = 7 AND started_us <= " + str(NOW) + " ORDER BY started_us DESC, dedupe_key DESC LIMIT 50")
def _(v: Views) -> DataFrame:
    return route.checks_page(read.counted(v.checks), route.named_span("all", NOW), 50, validator=7).select("dedupe_key", "cls")


@query("route_params", "SELECT from_height, from_tx, greatest(timeout_days, retention_days) AS window_days, coalesce(lead(from_height) OVER (ORDER BY from_height, from_tx), -1) AS next_height FROM params")
def _(v: Views) -> DataFrame:
    spans = r.spans_of(v.params, [], ["from_height", "from_tx"])
    return spans.select("from_height", "from_tx", F.greatest("timeout_days", "retention_days").alias("window_days"), F.coalesce("next_from_height", F.lit(-1)).alias("next_height"))


@query("route_tip", "SELECT 'blob' AS what, promise_hash AS id, height FROM (SELECT * FROM publications ORDER BY height DESC, tx_index DESC, promise_hash DESC LIMIT 1) UNION ALL SELECT 'host', validator, height FROM (SELECT * FROM host_events ORDER BY height DESC, tx_index DESC, validator DESC LIMIT 1)")
def _(v: Views) -> DataFrame:
    blob = v.publications.orderBy(F.desc("height"), F.desc("tx_index"), F.desc("promise_hash")).limit(1).select(F.lit("blob").alias("what"), F.col("promise_hash").alias("id"), "height")
    return blob.unionByName(v.host_events.orderBy(F.desc("height"), F.desc("tx_index"), F.desc("validator")).limit(1).select(F.lit("host").alias("what"), F.col("validator").alias("id"), "height"))


@query("route_feed", f"""WITH e AS (SELECT 'first served' AS kind, min(started_us) AS at_us, validator AS key FROM checks WHERE cls = 'HEALTHY' GROUP BY validator
      UNION ALL SELECT 'registered', {EPOCH} + min(height) * {DAY}, validator FROM host_events WHERE host <> '' GROUP BY validator)
    SELECT * FROM e WHERE at_us >= {EPOCH} ORDER BY at_us DESC, kind, key LIMIT 60""")
def _(v: Views) -> DataFrame:
    served = v.checks.where("cls = 'HEALTHY'").groupBy(F.col("validator").alias("key")).agg(F.min("started_us").alias("at_us")).withColumn("kind", F.lit("first served"))
    registered = v.host_events.where("host <> ''").groupBy(F.col("validator").alias("key")).agg((EPOCH + F.min("height") * DAY).alias("at_us")).withColumn("kind", F.lit("registered"))
    return route.feed([served, registered], EPOCH, 60).select("kind", "at_us", "key")


@query("open_endpoints", "SELECT validator, host, height FROM (SELECT *, lead(height) OVER (PARTITION BY validator ORDER BY height, tx_index, host) AS n FROM host_events) WHERE height <= 1200 AND (n IS NULL OR n > 1200) AND host <> ''")
def _(v: Views) -> DataFrame:
    return route.open_endpoints(r.spans_of(v.host_events, ["validator"], ["height", "tx_index", "host"]), 1200).select("validator", "host", "height")


@query("rows_per_blob", "SELECT blob_version, arg_max(needed_rows, (height, tx_index, promise_hash))::BIGINT AS rows FROM publications GROUP BY blob_version")
def _(v: Views) -> DataFrame:
    return route.rows_per_blob(v.publications)


@query("scan_gaps_joined", """WITH g AS (SELECT first, last FROM scan_gaps UNION ALL SELECT last + 1, last + 20 FROM scan_gaps WHERE first % 800 = 120 UNION ALL SELECT first + 3, last - 3 FROM scan_gaps),
    m AS (SELECT *, CASE WHEN first > coalesce(max(last) OVER (ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 THEN 1 ELSE 0 END AS fresh FROM g), n AS (SELECT *, sum(fresh) OVER (ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT min(first) AS first, max(last) AS last FROM n GROUP BY run""")
def _(v: Views) -> DataFrame:
    g = v.scan_gaps
    more = g.where("first % 800 = 120").select((F.col("last") + 1).alias("first"), (F.col("last") + 20).alias("last"))
    return route.unique_gaps(g.union(more).union(g.select(F.col("first") + 3, F.col("last") - 3)))


@query("unassignable", f"SELECT count(*) AS n, count(*) FILTER (settled_us >= {NOW - 60 * DAY}) AS recent FROM publications WHERE tx_code = 0 AND promise_hash NOT IN (SELECT promise_hash FROM assignments)")
def _(v: Views) -> DataFrame:
    rows = v.publications.where("tx_code = 0").join(v.assignments.select("promise_hash"), "promise_hash", "left_anti")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("settled_us") >= NOW - 60 * DAY).alias("recent"))




@query("readable_blobs", "SELECT promise_hash, publisher FROM publications p WHERE EXISTS (SELECT 1 FROM checks c WHERE c.promise_hash = p.promise_hash AND (c.verified OR c.tcp_ok OR c.outcome = 'TCP_REFUSED'))")
def _(v: Views) -> DataFrame:
    return route.shaped(route.readable(v.publications, v.checks), ["promise_hash", "publisher"], ["height"], False)


@query("resolved_addresses")
def _(v: Views) -> DataFrame:
    keys = v.validators.select("validator", F.substring(F.sha2(F.col("validator").cast("string"), 256), 1, 40).alias("hex"))
    forms = keys.select(F.explode(F.array(F.upper("hex"), codecs.to_bech32("val")("hex"), codecs.to_bech32("oper")("hex"), F.lit("unknown"))).alias("address"))
    return route.resolved(forms, keys).groupBy("validator").agg(F.count(F.lit(1)).alias("forms"))
