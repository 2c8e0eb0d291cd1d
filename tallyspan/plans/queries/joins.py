"""Queries of joins that are not on equality, histories, transitions and late verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.operators import histories as h
from tallyspan.operators import ranges as r
from tallyspan.operators.tallies import latest
from tallyspan.plans.registry import query
from tallyspan.plans.views import DAY, NOW, TOLERANCE, Views

JAN_2024 = 1_704_067_200_000_000


@query("interval_overlap", "SELECT DISTINCT p.promise_hash, u.id FROM publications p JOIN uncertain u ON p.promise_height - 1 <= u.to_height AND p.height >= u.from_height")
def _(v: Views) -> DataFrame:
    spans = v.publications.select("promise_hash", (F.col("promise_height") - 1).alias("lo"), F.col("height").alias("hi"))
    return r.overlapping(spans, v.uncertain.select(F.col("from_height").alias("lo"), F.col("to_height").alias("hi"), "id"), "promise_hash", keep="id")


@query("point_in_range", "SELECT v.validator, v.address, coalesce((SELECT arg_min(g.asn, g.line) FROM ranges g WHERE g.v6 = (v.validator % 3 = 0) AND v.address BETWEEN g.first AND g.last), 'none') AS asn FROM validators v")
def _(v: Views) -> DataFrame:
    points = v.validators.select("validator", "address", (F.col("validator") % 3 == 0).alias("v6"))
    return r.first_range(points, v.ranges, "address", "v6", "asn").select("validator", "address", F.coalesce("asn", F.lit("none")).alias("asn"))


@query("provider_fallback", """WITH a AS (SELECT v.validator, v.country, (SELECT arg_min(g.asn, g.line) FROM ranges g WHERE g.v6 AND v.address BETWEEN g.first AND g.last) AS one, (SELECT arg_min(g.asn, g.line) FROM ranges g WHERE NOT g.v6 AND v.address BETWEEN g.first AND g.last) AS two FROM validators v)
    SELECT validator, coalesce(one, two, country) AS host_group, CASE WHEN one IS NOT NULL THEN 'first' WHEN two IS NOT NULL THEN 'second' ELSE 'registry' END AS source FROM a""")
def _(v: Views) -> DataFrame:
    points = v.validators.select("validator", "address", "country")
    one = r.first_range(points.withColumn("v6", F.lit(True)), v.ranges, "address", "v6", "asn").withColumnRenamed("asn", "one")
    joined = r.first_range(one.withColumn("v6", F.lit(False)), v.ranges, "address", "v6", "asn").withColumnRenamed("asn", "two")
    source = F.when(F.col("one").isNotNull(), "first").when(F.col("two").isNotNull(), "second").otherwise("registry")
    return joined.select("validator", F.coalesce("one", "two", "country").alias("host_group"), source.alias("source"))


@query("params_as_of", """SELECT promise_hash, coalesce(timeout_days, -1) AS timeout_days, coalesce(retention_days, -1) AS retention_days FROM publications p LEFT JOIN LATERAL (SELECT timeout_days, retention_days FROM params WHERE (from_height, from_tx) <= (p.height, p.tx_index) ORDER BY from_height DESC, from_tx DESC LIMIT 1) ON true""")
def _(v: Views) -> DataFrame:
    found = h.params_at(v.publications, v.params)
    return found.select("promise_hash", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("timeout_days", "retention_days")])


@query("deadline_candidates", f"""WITH c AS (
      SELECT p.promise_hash, p.created_us, a.* FROM publications p JOIN LATERAL (SELECT timeout_days, retention_days FROM params WHERE from_height < p.promise_height OR (from_height = p.promise_height - 1) ORDER BY from_height DESC LIMIT 1) a ON true WHERE EXISTS (SELECT 1 FROM params x WHERE (x.from_height, x.from_tx) <= (p.height, p.tx_index))
      UNION ALL SELECT p.promise_hash, p.created_us, x.timeout_days, x.retention_days FROM publications p JOIN params x ON x.from_height >= p.promise_height - 1 AND (x.from_height, x.from_tx) <= (p.height, p.tx_index))
    SELECT promise_hash, min(created_us + greatest(timeout_days, retention_days) * {DAY}) AS must_serve_us, count(DISTINCT (timeout_days, retention_days)) > 1 AS ambiguous FROM c GROUP BY promise_hash""")
def _(v: Views) -> DataFrame:
    return h.deadlines(v.publications, v.params, DAY)


@query("host_at_settlement", """WITH p AS (SELECT promise_hash, validator, height, tx_index, height * 100 + tx_index AS at FROM publications JOIN assignments USING (promise_hash)),
    e AS (SELECT validator, height * 100 + tx_index AS at, height AS since, max(host) AS host FROM host_events GROUP BY ALL),
    f AS (SELECT p.*, e.host, e.since FROM p ASOF LEFT JOIN e ON p.validator = e.validator AND p.at >= e.at),
    g AS (SELECT *, (SELECT count(*) FROM scan_gaps s WHERE s.last > coalesce(f.since, 0) AND s.first <= f.height) > 0 AS gap FROM f)
    SELECT promise_hash, validator, CASE WHEN gap THEN 'gap' WHEN host IS NULL THEN 'no_seed' WHEN host = '' THEN 'none' ELSE 'on_record' END AS source, CASE WHEN NOT gap AND host IS NOT NULL THEN host ELSE '' END AS host FROM g""")
def _(v: Views) -> DataFrame:
    return _hosts(v, v.publications)


def _hosts(v: Views, publications: DataFrame) -> DataFrame:
    pairs = publications.join(v.assignments.select("promise_hash", "validator"), "promise_hash")
    return h.hosts_at(pairs, v.host_events, v.scan_gaps).select("promise_hash", "validator", "source", "host")


@query("endpoint_history", """WITH b AS (SELECT *, lag(host) OVER w AS previous, lag(height) OVER w AS ph FROM host_events WINDOW w AS (PARTITION BY validator ORDER BY height, tx_index, host)),
    g AS (SELECT *, EXISTS (SELECT 1 FROM scan_gaps s WHERE s.last > coalesce(b.ph, 0) AND s.first <= b.height) AS gap FROM b)
    SELECT validator, height, tx_index, host, coalesce(previous, '-') AS previous, CASE WHEN gap THEN 'after_gap' WHEN previous IS NULL THEN 'before_record' WHEN previous = host THEN 'same' WHEN previous = '' THEN 'registered' ELSE 'changed' END AS step FROM g""")
def _(v: Views) -> DataFrame:
    return h.endpoint_steps(v.host_events, v.scan_gaps).select("validator", "height", "tx_index", "host", F.coalesce("previous", F.lit("-")).alias("previous"), "step")


@query("host_event_costs", "SELECT e.validator, e.height, e.tx_index, coalesce(c.gas, -1) AS gas FROM host_events e LEFT JOIN (SELECT height, tx_index, min(gas) AS gas FROM tx_costs GROUP BY ALL) c ON c.height = e.height AND c.tx_index = e.tx_index - 1")
def _(v: Views) -> DataFrame:
    return h.paired_costs(v.host_events, v.tx_costs).select("validator", "height", "tx_index", F.coalesce("gas", F.lit(-1)).alias("gas"))


@query("history_without_repeats", "SELECT validator, height, tx_index, host FROM (SELECT *, lag(host) OVER (PARTITION BY validator ORDER BY height, tx_index, host) AS b FROM host_events) WHERE b IS DISTINCT FROM host")
def _(v: Views) -> DataFrame:
    return r.without_repeats(v.host_events, ["validator"], ["height", "tx_index", "host"], ["host"]).select("validator", "height", "tx_index", "host")


@query("history_spans", "SELECT validator, height, host, coalesce(lead(height) OVER (PARTITION BY validator ORDER BY height, tx_index, host), -1) AS next_height FROM host_events")
def _(v: Views) -> DataFrame:
    return r.spans_of(v.host_events, ["validator"], ["height", "tx_index", "host"]).select("validator", "height", "host", F.coalesce("next_height", F.lit(-1)).alias("next_height"))


@query("latest_host", "SELECT validator, host, height FROM (SELECT *, row_number() OVER (PARTITION BY validator ORDER BY height DESC, tx_index DESC, host DESC) AS k FROM host_events) WHERE k = 1")
def _(v: Views) -> DataFrame:
    return latest(v.host_events, ["validator"], [F.desc("height"), F.desc("tx_index"), F.desc("host")]).select("validator", "host", "height")


_SNAP = "SELECT validator, arg_max(host, (height, tx_index, host)) AS host FROM host_events WHERE height < {} GROUP BY validator"


@query("snapshot_diff", f"SELECT validator, coalesce(o.host, '-') AS old, coalesce(n.host, '-') AS new, CASE WHEN o.host IS NULL THEN 'open' WHEN n.host IS NULL THEN 'close' ELSE 'move' END AS change FROM ({_SNAP.format(900)}) o FULL JOIN (SELECT * FROM ({_SNAP.format(1700)}) WHERE validator % 7 <> 0) n USING (validator) WHERE o.host IS DISTINCT FROM n.host")
def _(v: Views) -> DataFrame:
    def at(height: int) -> DataFrame:
        rows = v.host_events.where(F.col("height") < height)
        return rows.groupBy("validator").agg(F.max(F.struct("height", "tx_index", "host"))["host"].alias("host"))

    found = h.snapshot_diff(at(900), at(1700).where("validator % 7 <> 0"), "validator", "host")
    return found.select("validator", F.coalesce("old", F.lit("-")).alias("old"), F.coalesce("new", F.lit("-")).alias("new"), "change")


@query("queue_changes", """WITH s AS (SELECT publisher AS key, at_us, max(CASE WHEN promise_hash % 3 = 0 THEN NULL ELSE amount END) AS amount FROM payments GROUP BY ALL),
    b AS (SELECT *, lag(amount) OVER w AS was, max(amount) OVER (PARTITION BY key ORDER BY at_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ever FROM s WINDOW w AS (PARTITION BY key ORDER BY at_us)),
    c AS (SELECT *, CASE WHEN amount IS NULL AND was IS NOT NULL THEN 'gone' WHEN amount IS NOT NULL AND was IS NULL AND ever IS NOT NULL THEN 'reopened' WHEN amount IS NOT NULL AND was IS NULL THEN 'appeared' WHEN amount < was THEN 'reduced' WHEN amount > was THEN 'raised' END AS change FROM b)
    SELECT key, at_us, coalesce(amount, -1) AS amount, coalesce(was, -1) AS was, change FROM c WHERE change IS NOT NULL""")
def _(v: Views) -> DataFrame:
    snapshots = v.payments.groupBy(F.col("publisher").alias("key"), "at_us").agg(F.max(F.when(F.col("promise_hash") % 3 != 0, F.col("amount"))).alias("amount"))
    found = h.queue_changes(snapshots)
    return found.select("key", "at_us", F.coalesce("amount", F.lit(-1)).alias("amount"), F.coalesce("was", F.lit(-1)).alias("was"), "change")


_RUNS = """WITH m AS (SELECT *, CASE WHEN {value} IS DISTINCT FROM lag({value}) OVER (PARTITION BY validator ORDER BY at_us, seq) THEN 1 ELSE 0 END AS fresh FROM beats WHERE {where}),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY validator ORDER BY at_us, seq) AS run FROM m),
    g AS (SELECT validator, run, any_value({value}) AS state, count(*) AS beats, min(at_us) AS at_us, arg_min(host, (at_us, seq)) AS host FROM n GROUP BY ALL),
    l AS (SELECT *, lag(state) OVER (PARTITION BY validator ORDER BY run) AS was FROM g WHERE beats >= 3),
    c AS (SELECT * FROM l WHERE state IS DISTINCT FROM was)"""


@query("reachability_transitions", _RUNS.format(value="up", where="true") + """
    SELECT * FROM (SELECT validator, CASE WHEN state THEN 'recovered' ELSE 'unreachable' END AS kind, at_us, host, coalesce(CASE WHEN state THEN lag(at_us) OVER (PARTITION BY validator ORDER BY run) END, -1) AS since_us, beats, was FROM c) WHERE was IS NOT NULL""".replace("SELECT * FROM (", "SELECT validator, kind, at_us, host, since_us, beats FROM ("))
def _(v: Views) -> DataFrame:
    return h.transitions(v.beats).withColumn("since_us", F.coalesce("since_us", F.lit(-1)))


@query("identity_transitions", _RUNS.format(value="identity", where="up AND identity <> ''") + """
    SELECT validator, kind, identity, at_us, since_us FROM (SELECT validator, CASE WHEN state = 'verified' THEN 'identity_restored' ELSE 'identity_problem' END AS kind, state AS identity, at_us, was,
      coalesce(CASE WHEN state = 'verified' THEN last_value(CASE WHEN was = 'verified' THEN at_us END IGNORE NULLS) OVER (PARTITION BY validator ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, -1) AS since_us FROM c) WHERE was IS NOT NULL""")
def _(v: Views) -> DataFrame:
    return h.identity_transitions(v.beats).withColumn("since_us", F.coalesce("since_us", F.lit(-1)))


CONFIRM_WITHIN = 15 * 60_000_000


@query("flaky_beats", f"""WITH a AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY validator, host, vantage ORDER BY at_us, seq), false) AS flaky FROM beats),
    o AS (SELECT a.seq, arg_max(b.up, (b.at_us, b.seq)) AS up FROM a JOIN beats b ON b.validator = a.validator AND b.host = a.host AND b.vantage <> a.vantage AND b.at_us > a.at_us - {CONFIRM_WITHIN} AND (b.at_us, b.seq) <= (a.at_us, a.seq) WHERE NOT a.up GROUP BY a.seq)
    SELECT a.seq, a.validator, a.flaky, CASE WHEN o.up THEN 'up' WHEN NOT o.up THEN 'down' ELSE 'none' END AS elsewhere FROM a LEFT JOIN o USING (seq) WHERE NOT a.up""")
def _(v: Views) -> DataFrame:
    return h.confirmed_elsewhere(v.beats, CONFIRM_WITHIN)


@query("flaky_beats_by_day", f"""WITH o AS (SELECT a.seq, arg_max(b.up, (b.at_us, b.seq)) AS up FROM beats a JOIN beats b ON b.validator = a.validator AND b.host = a.host AND b.vantage <> a.vantage AND b.at_us > a.at_us - {DAY} AND (b.at_us, b.seq) <= (a.at_us, a.seq) WHERE NOT a.up GROUP BY a.seq)
    SELECT CASE WHEN o.up THEN 'up' WHEN NOT o.up THEN 'down' ELSE 'none' END AS elsewhere, count(*) AS n FROM beats a LEFT JOIN o USING (seq) WHERE NOT a.up GROUP BY 1""")
def _(v: Views) -> DataFrame:
    return h.confirmed_elsewhere(v.beats, DAY).groupBy("elsewhere").agg(F.count(F.lit(1)).alias("n"))


_ROWS = "list_transform(range(0, 1 + promise_hash % 3), lambda i: (validator * 7 + i * (promise_hash % 5)) % 50)"


@query("late_shadow_verdicts", f"""WITH c AS (SELECT a.promise_hash, validator, commitment, settled_us, must_serve_us, CASE WHEN promise_hash % 11 = 0 THEN NULL ELSE list_sort({_ROWS}) END AS rows FROM assignments a JOIN publications USING (promise_hash)),
    w AS (SELECT DISTINCT dedupe_key, validator, commitment, started_us, list_sort(list_transform(range(0, 1 + first_row % 3), lambda i: (validator * 7 + i * (first_row % 5)) % 50)) AS rows FROM checks WHERE outcome IN ('WRONG_ROWS', 'PARTIAL') AND verified AND started_us + {DAY} <= {NOW}),
    f AS (SELECT w.dedupe_key, min(c.promise_hash) FILTER (c.rows = w.rows) AS s, bool_or(c.rows IS NULL) AS u FROM w JOIN c ON c.validator = w.validator AND c.commitment = w.commitment AND c.settled_us <= w.started_us + {DAY} AND c.must_serve_us + {TOLERANCE} >= w.started_us GROUP BY 1)
    SELECT w.dedupe_key, CASE WHEN s IS NOT NULL THEN 'SHADOWED_SHARD' WHEN u THEN 'PROBE_ERROR' ELSE 'UNMATCHED_GENUINE' END AS cls, coalesce(s, -1) AS shadowed_by FROM w LEFT JOIN f USING (dedupe_key)""")
def _(v: Views) -> DataFrame:
    def rows(n: str) -> F.Column:
        return F.transform(F.sequence(F.lit(0), (F.col(n) % 3).cast("int")), lambda i: (F.col("validator") * 7 + i * (F.col(n) % 5)) % 50)

    candidates = v.assignments.select("promise_hash", "validator").join(v.publications.select("promise_hash", "commitment", "settled_us", "must_serve_us"), "promise_hash")
    candidates = candidates.withColumn("rows", F.when(F.col("promise_hash") % 11 != 0, rows("promise_hash")))
    waiting = v.checks.where("outcome in ('WRONG_ROWS', 'PARTIAL') and verified").select("dedupe_key", "validator", "commitment", "started_us", rows("first_row").alias("rows")).distinct()
    return h.late_verdicts(waiting, candidates, NOW, DAY, TOLERANCE).withColumn("shadowed_by", F.coalesce("shadowed_by", F.lit(-1)))


@query("transaction_lookup", """WITH k AS (SELECT DISTINCT height FROM tx_costs UNION SELECT DISTINCT height FROM publications UNION SELECT unnest(range(2300, 2600))),
    s AS (SELECT height, 0 AS place, 'cost' AS source, min(gas) AS detail FROM tx_costs GROUP BY ALL UNION ALL SELECT height, 1, 'publication', min(promise_hash) FROM publications GROUP BY ALL UNION ALL SELECT height, 2, 'host', min(validator) FROM host_events GROUP BY ALL)
    SELECT k.height, coalesce(arg_min(source, place), 'unknown') AS source, coalesce(arg_min(detail, place), -1) AS detail FROM k LEFT JOIN s USING (height) GROUP BY k.height""")
def _(v: Views) -> DataFrame:
    more = v.spark.range(2300, 2600).select(F.col("id").alias("height"))
    keys = v.tx_costs.select("height").union(v.publications.select("height")).union(more).distinct()
    sources = [("cost", v.tx_costs.select("height", F.col("gas").alias("detail"))), ("publication", v.publications.select("height", F.col("promise_hash").alias("detail"))), ("host", v.host_events.select("height", F.col("validator").alias("detail")))]
    return h.cascade(keys, sources, "height").withColumn("detail", F.coalesce("detail", F.lit(-1)))


@query("known_validators", "SELECT DISTINCT validator FROM beats WHERE validator IN (SELECT validator FROM assignments) OR validator IN (SELECT validator FROM host_events) OR validator IN (SELECT validator FROM validators)")
def _(v: Views) -> DataFrame:
    known = v.assignments.select("validator").union(v.host_events.select("validator")).union(v.validators.select("validator")).distinct()
    return v.beats.select("validator").distinct().join(known, "validator", "left_semi")


@query("settlement_join", "SELECT p.promise_hash, coalesce(pay.amount, -1) AS amount FROM publications p LEFT JOIN payments pay ON pay.promise_hash = p.promise_hash AND pay.kind = 'settlement'")
def _(v: Views) -> DataFrame:
    paid = v.payments.where("kind = 'settlement'").select("promise_hash", "amount")
    return v.publications.join(paid, "promise_hash", "left").select("promise_hash", F.coalesce("amount", F.lit(-1)).alias("amount"))
