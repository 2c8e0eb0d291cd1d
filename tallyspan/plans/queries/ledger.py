"""Queries of what is done with records on their way in and out: windows, times, keys, states, manifests, dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.operators import routes as route
from tallyspan.operators import tallies as t
from tallyspan.plans.registry import query
from tallyspan.plans.views import DAY, HOUR, NOW, Views
from tallyspan.sources import records, sinks
from tallyspan.sources.synthetic import text_of
from tallyspan.streaming.passes import ready

_SPANS = {"24h": 1, "7d": 7, "30d": 30}


@query("named_windows", " UNION ALL ".join(f"SELECT '{n}' AS name, {NOW - d * DAY - HOUR} AS rows_from, count(*) AS n FROM raw_checks WHERE started_us BETWEEN {NOW - d * DAY} AND {NOW}" for n, d in _SPANS.items()) + f" UNION ALL SELECT 'all', -1, count(*) FROM raw_checks WHERE started_us <= {NOW}")
def _(v: Views) -> DataFrame:
    out = None
    for name in route.LENGTHS:
        span = route.named_span(name, NOW)
        rows = t.window(v.raw_checks, "started_us", span.start, span.end)
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(-1 if span.rows_from is None else span.rows_from).alias("rows_from"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("canonical_times", """WITH d AS (SELECT promise_hash, '199' || (promise_hash % 8) || '-' || lpad((promise_hash % 13)::VARCHAR, 2, '0') || '-' || lpad((promise_hash % 32)::VARCHAR, 2, '0') AS day, CASE WHEN promise_hash % 4 = 0 THEN '' ELSE '.' || blob_size % 1000 END AS part FROM publications)
    SELECT promise_hash, coalesce(CASE WHEN try_cast(day AS DATE) IS NOT NULL THEN day || 'T01:02:03.' || rpad(substr(part, 2), 9, '0') || 'Z' END, '') AS time FROM d""")
def _(v: Views) -> DataFrame:
    two = lambda n: F.lpad((F.col("promise_hash") % n).cast("string"), 2, "0")
    part = F.when(F.col("promise_hash") % 4 == 0, "").otherwise(F.concat(F.lit("."), (F.col("blob_size") % 1000).cast("string")))
    text = F.concat(F.lit("199"), (F.col("promise_hash") % 8).cast("string"), F.lit("-"), two(13), F.lit("-"), two(32), F.lit("T01:02:03"), part, F.lit("Z"))
    return v.publications.select("promise_hash", F.coalesce(records.canonical(text), F.lit("")).alias("time"))


@query("record_keys", """SELECT concat_ws('|', vantage, promise_hash, validator, strftime(make_timestamp(scheduled_us), '%Y-%m-%dT%H:%M:%S.%f') || '000Z') || CASE WHEN first_row % 3 > 0 THEN '|' || first_row % 3 ELSE '' END AS key, count(*) AS n FROM raw_checks GROUP BY 1""")
def _(v: Views) -> DataFrame:
    scheduled = records.canonical(text_of("scheduled_us"))
    key = records.dedupe_key(F.col("vantage"), F.col("promise_hash"), F.col("validator"), scheduled, F.col("first_row") % 3)
    return v.raw_checks.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("latest_hosts_state", "SELECT validator, arg_max(host, (height, tx_index, host)) AS host FROM host_events GROUP BY validator")
def _(v: Views) -> DataFrame:
    return sinks.latest_state(v.host_events, ["validator"], [F.desc("height"), F.desc("tx_index"), F.desc("host")]).select("validator", "host")


@query("guarded_hosts_state", "SELECT validator, coalesce(arg_min(host, (height, tx_index, host)) FILTER (host = ''), arg_max(host, (height, tx_index, host))) AS host, arg_min(height, (height, tx_index, host)) FILTER (host = '') IS NOT NULL AS settled FROM host_events GROUP BY validator")
def _(v: Views) -> DataFrame:
    found = sinks.guarded_state(v.host_events, ["validator"], F.col("host") == "", [F.col("height"), F.col("tx_index"), F.col("host")])
    return found.select("validator", "host", (F.col("host") == "").alias("settled"))


@query("reproduced_lines", """WITH a AS (SELECT publisher, found || '|' || denom AS raw FROM escrow), b AS (SELECT publisher, CASE WHEN amount % 2 = 0 THEN 'true' ELSE 'false' END || '|unit' AS raw FROM withdrawals)
    SELECT state, count(*) AS n FROM (SELECT CASE WHEN b.raw IS NULL THEN 'lost' WHEN a.raw IS NULL THEN 'new' WHEN a.raw = b.raw THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b USING (publisher)
      UNION ALL SELECT CASE WHEN a.raw IS NULL THEN 'lost' WHEN b.raw IS NULL THEN 'new' WHEN a.raw = b.raw THEN 'same' ELSE 'changed' END FROM a FULL JOIN b USING (publisher)) GROUP BY state""")
def _(v: Views) -> DataFrame:
    a = v.escrow.select("publisher", F.concat_ws("|", F.col("found").cast("string"), "denom").alias("raw"))
    b = v.withdrawals.select("publisher", F.concat_ws("|", (F.col("amount") % 2 == 0).cast("string"), F.lit("unit")).alias("raw"))
    return sinks.reproduced(a, b, "publisher").unionByName(sinks.reproduced(b, a, "publisher")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_QUARTERS = ", ".join(f"sum(('0x' || substr(s, {16 * k + 1}, 16))::UBIGINT::HUGEINT)::VARCHAR" for k in range(4))


@query("export_manifest", f"""WITH l AS (SELECT kind AS file, sha256(dedupe_key || '|' || amount) AS s, strftime(make_timestamp(at_us), '%Y-%m-%d') AS day, strftime(make_timestamp(at_us + amount % 3 * {DAY}), '%Y-%m-%d') AS exported FROM payments)
    SELECT file, day, count(*) AS lines, sha256(concat_ws(':', count(*)::VARCHAR, {_QUARTERS})) AS sha256, count(*) FILTER (day < exported) AS late FROM l GROUP BY file, day""")
def _(v: Views) -> DataFrame:
    day = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd")
    lines = v.payments.select(F.col("kind").alias("file"), F.concat_ws("|", "dedupe_key", F.col("amount").cast("string")).alias("raw"), text_of("at_us").alias("at"), day(F.col("at_us") + F.col("amount") % 3 * DAY).alias("exported"))
    return sinks.manifest(lines, "at", "exported")


@query("ready_records", "SELECT kind, count(*) FILTER (promise_hash IN (SELECT promise_hash FROM assignments WHERE attested)) AS ready, count(*) FILTER (promise_hash NOT IN (SELECT promise_hash FROM assignments WHERE attested)) AS waiting FROM payments GROUP BY kind")
def _(v: Views) -> DataFrame:
    now, later = ready(v.payments, v.assignments.where("attested"), "promise_hash")
    marked = now.select("kind", F.lit(True).alias("now")).unionByName(later.select("kind", F.lit(False).alias("now")))
    return marked.groupBy("kind").agg(F.count_if("now").alias("ready"), F.count_if(~F.col("now")).alias("waiting"))


@query("own_network_records", "SELECT count(*) FILTER (validator IN (SELECT validator FROM validators) AND height <= 1200) AS ours, count(*) FILTER (validator NOT IN (SELECT validator FROM validators) OR height > 1200) AS foreign_ones FROM host_events")
def _(v: Views) -> DataFrame:
    events = v.host_events.withColumn("validator_address", F.col("validator"))
    ours, others = records.own_network(events, v.validators, 1200 - 100_000 - 60, 60)
    marked = ours.select(F.lit(True).alias("own")).unionByName(others.select(F.lit(False).alias("own")))
    return marked.agg(F.count_if("own").alias("ours"), F.count_if(~F.col("own")).alias("foreign_ones"))


@query("listed_providers", "SELECT validator, CASE asn WHEN 'as1' THEN 'One' WHEN 'as4' THEN 'Four' ELSE asn END AS provider FROM validators")
def _(v: Views) -> DataFrame:
    listed = v.spark.createDataFrame([("as1", "One"), ("as4", "Four"), ("as99", "None")], "asn string, provider_name string")
    return route.with_provider(v.validators.select("validator", "asn"), listed).select("validator", "provider")


@query("explained_failures", "SELECT promise_hash, CASE WHEN blob_version = 0 THEN 'insufficient funds' ELSE 'code 5 x' END AS reason FROM publications WHERE tx_code <> 0")
def _(v: Views) -> DataFrame:
    failed = v.publications.where("tx_code <> 0").select("promise_hash", F.when(F.col("blob_version") == 0, "sdk").otherwise("x").alias("codespace"), F.col("tx_code").cast("int").alias("code"))
    return route.explained(failed, [("sdk", 5, "insufficient funds"), ("sdk", 4, "unauthorized")]).select("promise_hash", "reason")


@query("tip_pace", """WITH b AS (SELECT height, min(settled_us) + height * height AS at_us FROM publications GROUP BY height),
    w AS (SELECT *, count(*) OVER p - 1 AS seen, at_us - min(at_us) OVER p AS span, height - min(height) OVER p AS blocks FROM b WINDOW p AS (ORDER BY height ROWS BETWEEN 600 PRECEDING AND CURRENT ROW))
    SELECT height, CASE WHEN seen < 40 THEN 6000000 ELSE span // blocks END AS pace_us FROM w""")
def _(v: Views) -> DataFrame:
    blocks = v.publications.groupBy("height").agg(F.min("settled_us").alias("first")).select("height", (F.col("first") + F.col("height") * F.col("height")).alias("at_us"))
    return route.pace(blocks).select("height", "pace_us")


@query("resolved_forms", "SELECT validator, 3 AS forms FROM validators")
def _(v: Views) -> DataFrame:
    """Every form of every validator's address leads back to it: upper-case hexadecimal and bech32 under two prefixes."""
    from tallyspan.functions import codecs

    keys = v.validators.select("validator", F.substring(F.sha2(F.col("validator").cast("string"), 256), 1, 40).alias("hex"))
    forms = keys.select(F.col("validator").alias("of"), F.explode(F.array(F.upper("hex"), codecs.to_bech32("val")("hex"), codecs.to_bech32("oper")("hex"))).alias("address"))
    found = route.resolved(forms, keys)
    return found.where("of = validator").groupBy("validator").agg(F.count_distinct("address").cast("int").alias("forms"))
