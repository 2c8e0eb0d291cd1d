"""Queries of payments, publishers, namespaces and withdrawals, sorts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.functions import rules
from tallyspan.operators import market as m
from tallyspan.operators import paging
from tallyspan.plans.registry import query
from tallyspan.plans.views import DAY, HOUR, NOW, Views

START = NOW - 400 * DAY
LATE = NOW + 1300 * DAY


@query("market_totals", f"""WITH w AS (SELECT pay.*, k.blob_key FROM payments pay LEFT JOIN (SELECT promise_hash, blob_version || ':' || commitment AS blob_key FROM publications) k USING (promise_hash) WHERE at_us BETWEEN {START} AND {NOW}),
    s AS (SELECT * FROM w WHERE kind = 'settlement')
    SELECT (SELECT count(*) FROM s) AS settlements, (SELECT sum(amount)::BIGINT FROM s) AS fees, (SELECT sum(blob_size)::BIGINT FROM s) AS bytes, (SELECT count(DISTINCT publisher) FROM s) AS publishers, (SELECT count(DISTINCT namespace) FROM s WHERE namespace <> '') AS namespaces,
      (SELECT count(DISTINCT coalesce(blob_key, 'promise:' || promise_hash)) FROM s) AS blobs, (SELECT count(*) FROM w WHERE kind = 'timeout') AS timeouts, (SELECT coalesce(sum(amount), 0)::BIGINT FROM w WHERE kind = 'timeout') AS timed_out,
      (SELECT count(*) FROM w WHERE kind = 'deposit' AND denom = 'unit') AS deposits, round((SELECT sum(amount) FROM s) * 1048576.0 / (SELECT sum(blob_size) FROM s), 6)::DOUBLE AS per_mib""")
def _(v: Views) -> DataFrame:
    return m.totals(v.payments, v.publications, START, NOW)


@query("market_hours", f"SELECT at_us // {HOUR} * {HOUR} AS at_us, count(*) AS settlements, sum(amount)::BIGINT AS fees, sum(blob_size)::BIGINT AS bytes FROM payments WHERE kind = 'settlement' GROUP BY 1")
def _(v: Views) -> DataFrame:
    return m.series(v.payments, HOUR)


@query("market_days_filled", f"""WITH d AS (SELECT at_us // {DAY} * {DAY} AS at_us, count(*) AS settlements, sum(amount)::BIGINT AS fees, sum(blob_size)::BIGINT AS bytes FROM payments WHERE kind = 'settlement' GROUP BY 1)
    SELECT r.at_us, coalesce(settlements, 0) AS settlements, coalesce(fees, 0) AS fees, coalesce(bytes, 0) AS bytes, r.at_us + {DAY} > {NOW} AS partial FROM (SELECT unnest(range({START}, {NOW + DAY}, {DAY})) AS at_us) r LEFT JOIN d USING (at_us)""")
def _(v: Views) -> DataFrame:
    return m.filled(m.series(v.payments, DAY), DAY, START, NOW)


@query("publishers", f"""WITH w AS (SELECT publisher, count(*) FILTER (kind = 'settlement') AS settlements, coalesce(sum(blob_size) FILTER (kind = 'settlement'), 0)::BIGINT AS bytes, coalesce(sum(amount) FILTER (kind = 'settlement'), 0)::BIGINT AS fees,
      coalesce(max(blob_size) FILTER (kind = 'settlement'), 0) AS largest, count(*) FILTER (kind = 'timeout') AS timeouts, count(*) AS payments FROM payments WHERE at_us BETWEEN {START} AND {NOW} GROUP BY publisher)
    SELECT w.*, f.first_us, f.last_us, coalesce(e.balance, -1) AS balance, round(fees / nullif(sum(fees) OVER (), 0)::DOUBLE, 9) AS fee_share FROM w JOIN (SELECT publisher, min(at_us) AS first_us, max(at_us) AS last_us FROM payments GROUP BY publisher) f USING (publisher)
    LEFT JOIN (SELECT publisher, balance FROM escrow WHERE denom = 'unit' AND found) e USING (publisher)""")
def _(v: Views) -> DataFrame:
    return m.publishers(v.payments, v.escrow, START, NOW).withColumn("balance", F.coalesce("balance", F.lit(-1)))


@query("nested_windows", f"""SELECT name, (SELECT count(*) FROM payments WHERE kind = 'settlement' AND at_us <= {NOW} AND at_us > {NOW} - days * {DAY}) AS settlements, (SELECT coalesce(sum(amount), 0)::BIGINT FROM payments WHERE kind = 'settlement' AND at_us <= {NOW} AND at_us > {NOW} - days * {DAY}) AS fees
    FROM (VALUES ('24h', 1), ('7d', 7), ('30d', 30), ('all', 100000)) t(name, days)""")
def _(v: Views) -> DataFrame:
    return m.nested_windows(v.payments, NOW, {"24h": 1, "7d": 7, "30d": 30, "all": 100_000})


@query("namespaces", f"""SELECT namespace, count(*) AS promises, sum(p.blob_size)::BIGINT AS bytes, count(*) FILTER (settled_us >= {NOW - 30 * DAY}) AS recent, coalesce(sum(p.blob_size) FILTER (settled_us >= {NOW - 30 * DAY}), 0)::BIGINT AS recent_bytes,
      count(DISTINCT coalesce(pay.payer, p.publisher)) AS accounts, min(settled_us) AS first_us, max(settled_us) AS last_us FROM publications p LEFT JOIN (SELECT promise_hash, publisher AS payer FROM payments WHERE kind = 'settlement') pay USING (promise_hash) GROUP BY namespace""")
def _(v: Views) -> DataFrame:
    return m.namespaces(v.publications, v.payments, NOW)


@query("top_namespaces", """WITH f AS (SELECT publisher, namespace, count(*) AS settlements, max(at_us) AS last_us FROM payments WHERE kind = 'settlement' AND namespace <> '' GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY settlements DESC, last_us DESC, namespace) AS place FROM f) WHERE place <= 10""")
def _(v: Views) -> DataFrame:
    return m.top_namespaces(v.payments)


@query("unpaid_promises", "SELECT promise_hash FROM publications WHERE promise_hash NOT IN (SELECT promise_hash FROM payments WHERE kind IN ('settlement', 'timeout'))")
def _(v: Views) -> DataFrame:
    return m.unpaid(v.publications, v.payments).select("promise_hash")


@query("timeouts_by_account", "SELECT substr(processor, 4) AS account, count(*) AS n, sum(amount)::BIGINT AS amount FROM payments WHERE kind = 'timeout' GROUP BY 1")
def _(v: Views) -> DataFrame:
    return m.timeouts_by_account(v.payments)


@query("escrow_totals", "SELECT count(*) AS accounts, sum(balance)::BIGINT AS held FROM escrow WHERE found AND denom = 'unit'")
def _(v: Views) -> DataFrame:
    return v.escrow.where("found and denom = 'unit'").agg(F.count(F.lit(1)).alias("accounts"), F.sum("balance").alias("held"))


@query("charges", "SELECT promise_hash, coalesce(sum(amount) FILTER (kind = 'settlement'), 0)::BIGINT AS settled, coalesce(sum(amount) FILTER (kind = 'timeout'), 0)::BIGINT AS timed_out FROM payments WHERE kind IN ('settlement', 'timeout') GROUP BY 1")
def _(v: Views) -> DataFrame:
    return m.charges(v.payments)


@query("fee_formula", """SELECT promise_hash, 650000 + (blob_size + 262143) // 262144 * 5000 AS gas, CASE WHEN promise_hash % 2 = 0 THEN 650000 + (blob_size + 262143) // 262144 * 5000 ELSE ((650000 + (blob_size + 262143) // 262144 * 5000) * 4 + 999) // 1000 END AS fee FROM payments""")
def _(v: Views) -> DataFrame:
    gas, fee = rules.charge(F.col("blob_size"), F.when(F.col("promise_hash") % 2 == 0, 10).otherwise(11))
    return v.payments.select("promise_hash", gas.alias("gas"), fee.alias("fee"))


_RESOLVED = f"""WITH pairs AS (SELECT w.publisher, w.requested_at, p.dedupe_key AS payout FROM withdrawals w JOIN (SELECT *, (at_us - 788918400000000) // {DAY} AS height FROM payments WHERE kind = 'withdrawal_executed') p ON p.publisher = w.publisher AND p.amount = w.amount
      AND p.height > w.last_seen_height AND p.height <= w.gone_height AND p.at_us >= w.available_us WHERE w.gone_us >= w.available_us),
    sure AS (SELECT publisher, requested_at, payout FROM (SELECT *, count(*) OVER (PARTITION BY publisher, requested_at) AS a, count(*) OVER (PARTITION BY payout) AS b FROM pairs) WHERE a = 1 AND b = 1),
    done AS (SELECT w.*, payout, CASE WHEN gone_us < available_us THEN 'consumed' WHEN payout IS NOT NULL THEN 'executed' ELSE 'unattributed' END AS outcome FROM withdrawals w LEFT JOIN sure USING (publisher, requested_at))"""


def _resolved(v: Views) -> DataFrame:
    payouts = v.payments.where("kind = 'withdrawal_executed'").withColumn("height", F.expr(f"(at_us - 788918400000000) div {DAY}"))
    return m.resolve_withdrawals(v.withdrawals, payouts)


@query("resolved_withdrawals", f"{_RESOLVED} SELECT publisher, requested_at, amount, coalesce(payout, '') AS payout, outcome FROM done")
def _(v: Views) -> DataFrame:
    return _resolved(v).select("publisher", "requested_at", "amount", F.coalesce("payout", F.lit("")).alias("payout"), "outcome")


@query("withdrawal_summary", f"""{_RESOLVED} SELECT outcome, count(*) AS n, sum(amount)::BIGINT AS amount, min(gone_us - available_us) AS least_us, max(gone_us - available_us) AS most_us,
      list_sort(list(gone_us - available_us))[(count(*) - 1) // 2 + 1] AS median_us FROM done GROUP BY outcome""")
def _(v: Views) -> DataFrame:
    from tallyspan.operators.quantiles import lower_median

    done = _resolved(v).withColumn("wait_us", F.col("gone_us") - F.col("available_us"))
    found = done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.min("wait_us").alias("least_us"), F.max("wait_us").alias("most_us"))
    return found.join(lower_median(done, ["outcome"], "wait_us").select("outcome", F.col("wait_us").alias("median_us")), "outcome")


@query("open_withdrawals", f"""SELECT publisher, balance, coalesce(n, 0) AS pending, coalesce(a, 0) AS pending_amount FROM escrow LEFT JOIN (SELECT publisher, count(*) AS n, sum(amount)::BIGINT AS a FROM withdrawals WHERE gone_us > {NOW} GROUP BY publisher) USING (publisher)""")
def _(v: Views) -> DataFrame:
    return m.open_withdrawals(v.escrow, v.withdrawals, NOW)


@query("newest_blobs_page", "SELECT promise_hash, height, tx_index FROM publications WHERE namespace = 'ns3' AND (height, tx_index, promise_hash) < (1500, 5, 0) ORDER BY height DESC, tx_index DESC, promise_hash DESC LIMIT 51")
def _(v: Views) -> DataFrame:
    rows = paging.filtered(v.publications, {"namespace": "ns3"})
    return paging.before(rows, ["height", "tx_index", "promise_hash"], (1500, 5, 0), 50).select("promise_hash", "height", "tx_index")


@query("blob_page_offset", "SELECT promise_hash, height FROM publications ORDER BY height DESC, tx_index DESC, promise_hash DESC LIMIT 40 OFFSET 200")
def _(v: Views) -> DataFrame:
    return paging.newest(v.publications, ["height", "tx_index", "promise_hash"]).offset(200).limit(40).select("promise_hash", "height")


@query("merged_pages", """SELECT * FROM (SELECT 'blob' AS what, height, tx_index, promise_hash AS id FROM publications UNION ALL SELECT 'host', height, tx_index, validator FROM host_events) ORDER BY height DESC, tx_index DESC, what, id LIMIT 100""")
def _(v: Views) -> DataFrame:
    blobs = v.publications.select(F.lit("blob").alias("what"), "height", "tx_index", F.col("promise_hash").alias("id"))
    hosts = v.host_events.select(F.lit("host").alias("what"), "height", "tx_index", F.col("validator").alias("id"))
    return blobs.unionByName(hosts).orderBy(F.desc("height"), F.desc("tx_index"), "what", "id").limit(100)


@query("bounded_count", "SELECT count(*) AS n FROM (SELECT 1 FROM payments WHERE kind = 'timeout' LIMIT 1000)")
def _(v: Views) -> DataFrame:
    return paging.at_most(v.payments.where("kind = 'timeout'"), 1000)


@query("validator_order", "SELECT validator, power, row_number() OVER (ORDER BY power DESC, validator) AS place FROM validators")
def _(v: Views) -> DataFrame:
    return paging.placed(v.validators.select("validator", "power"), [F.desc("power"), F.col("validator")])


@query("stale_first", f"SELECT validator, coalesce(last_us, -1) AS last_us FROM validators LEFT JOIN (SELECT validator, max(at_us) AS last_us FROM beats WHERE up GROUP BY validator) USING (validator) ORDER BY last_us NULLS FIRST, validator LIMIT 30")
def _(v: Views) -> DataFrame:
    last = v.beats.where("up").groupBy("validator").agg(F.max("at_us").alias("last_us"))
    return v.validators.select("validator").join(last, "validator", "left").orderBy(F.asc_nulls_first("last_us"), "validator").limit(30).withColumn("last_us", F.coalesce("last_us", F.lit(-1)))
