"""Composite figures: one function per question that is asked as a whole, over the tables of the views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions import codecs, rules
from tallyspan.operators import paging
from tallyspan.operators import quantiles as q
from tallyspan.operators import tallies as t
from tallyspan.plans.views import DAY, HOUR

LENGTHS = {"24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY, "all": None}


@dataclass(frozen=True)
class Span:
    """[start, end], both ends included; no start: from the beginning."""

    start: int | None
    end: int

    @property
    def rows_from(self) -> int | None:
        """A lower bound for rows of promises settled in the span: an hour of slack, for pruning only."""
        return None if self.start is None else self.start - HOUR


def named_span(name: str | None, now: int, as_of: int | None = None) -> Span:
    """A named window that ends now, or at a past moment it is pinned to."""
    if (name or "24h") not in LENGTHS:
        raise ValueError(f"window must be one of {', '.join(LENGTHS)}")
    if as_of is not None and as_of > now:
        raise ValueError("as_of is in the future")
    end, length = now if as_of is None else as_of, LENGTHS[name or "24h"]
    return Span(None if length is None else end - length, end)


def service_word(counted: Column) -> Column:
    """What a validator's counted class says about one blob."""
    return (
        F.when(counted == "HEALTHY", "served").when(counted == "FAULT", "not served").when(counted == "RETENTION_UNVERIFIED", "withheld")
        .when(counted.isin(*rules.GAPS), "not read").otherwise("not counted")
    )


def validators(dimension: DataFrame, tallies: DataFrame, beats: DataFrame, signed: DataFrame, latency: DataFrame) -> DataFrame:
    """Every validator with its served and broken obligations, beats, signatures and median time; zeros where none."""
    parts = [tallies.select("validator", "served", "broken", "total"), t.beat_counts(beats).select("validator", "beats", "up"), signed.select("validator", "signed", "known"), latency.select("validator", "p50")]
    out = dimension.select("validator", "power", "moniker")
    for part in parts:
        out = out.join(part, "validator", "left")
    names = ("served", "broken", "total", "beats", "up", "signed", "known")
    return out.select("validator", "power", "moniker", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], F.coalesce("p50", F.lit(-1)).alias("p50"))


def network(tallies: DataFrame, checks: DataFrame, beats: DataFrame) -> DataFrame:
    """One row: obligations, checks, latency percentiles and who is up."""
    obligations = tallies.agg(F.sum("served").alias("served"), F.sum("broken").alias("broken"), F.sum("total").alias("total"))
    times = q.from_histogram(q.histogram(checks.where("verified"), [], "service_ms"), [], "service_ms", {"p50": 50, "p95": 95}).withColumnRenamed("n", "verified")
    newest = t.latest(beats, ["validator"], [F.desc("at_us"), F.desc("seq")]).agg(F.count_if("up").alias("up"), F.count(F.lit(1)).alias("known"))
    parts = obligations.unionByName(times, allowMissingColumns=True).unionByName(newest, allowMissingColumns=True)  # a row each
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def blobs_page(publications: DataFrame, statuses: DataFrame, charges: DataFrame, cursor: tuple, limit: int, **filters) -> DataFrame:
    """A page of blobs, newest first, with status and what was charged; the joins see the page's rows only."""
    page = paging.before(paging.filtered(publications, **filters), ["height", "tx_index", "promise_hash"], cursor, limit)
    joined = page.join(statuses.select("promise_hash", "status"), "promise_hash", "left").join(charges, "promise_hash", "left")
    return joined.select("promise_hash", "height", F.coalesce("status", F.lit("not_read")).alias("status"), F.coalesce("settled", F.lit(0)).alias("settled"))


def checks_page(checks: DataFrame, span: Span, limit: int, widest: int = 3000 * DAY, validator: int | None = None, cls: str | None = None, not_served: bool = False) -> DataFrame:
    """A page of checks of a span, newest first. A span wider than ``widest`` needs a validator: it would read everything."""
    if validator is None and (span.start is None or span.end - span.start > widest):
        raise ValueError("ask for a validator or for a shorter span")
    rows = t.window(checks, "started_us", span.start, span.end)
    rows = paging.filtered(rows, equal={k: v for k, v in (("validator", validator), ("cls", cls)) if v is not None})
    rows = rows.where("counted = 'FAULT'") if not_served else rows
    return rows.orderBy(F.desc("started_us"), F.desc("dedupe_key")).limit(limit)


def open_endpoints(spans: DataFrame, at: int) -> DataFrame:
    """Endpoints open at a height: begun at or before it, not yet followed by another."""
    return spans.where((F.col("height") <= at) & (F.col("next_height").isNull() | (F.col("next_height") > at)) & (F.col("host") != ""))


def feed(parts: list[DataFrame], since: int, limit: int) -> DataFrame:
    """Events of several kinds (kind, at_us, key) as one list, newest first, bounded by age and number."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("at_us") >= since).orderBy(F.desc("at_us"), "kind", "key").limit(limit)


def rows_per_blob(publications: DataFrame) -> DataFrame:
    """Rows that the newest blob of each version needs."""
    return publications.groupBy("blob_version").agg(F.max(F.struct("height", "tx_index", "promise_hash", "needed_rows"))["needed_rows"].alias("rows"))


def unique_gaps(gaps: DataFrame) -> DataFrame:
    """Scan gaps joined where they overlap or touch."""
    order = Window.partitionBy(F.lit(0)).orderBy("first", "last")  # gaps of one scanner: few rows
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = gaps.withColumn("__new", F.when(F.col("first") > F.coalesce(reach, F.lit(-1)) + 1, 1).otherwise(0))
    numbered = begun.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__run")


def with_provider(hosts: DataFrame, providers: DataFrame) -> DataFrame:
    """Hosts with the provider of their network number, itself where the list has none."""
    return hosts.join(providers, "asn", "left").withColumn("provider", F.coalesce("provider_name", "asn")).drop("provider_name")


def explained(failures: DataFrame, known: list[tuple[str, int, str]]) -> DataFrame:
    """Failed transactions (codespace, code) with their plain reason."""
    reasons = failures.sparkSession.createDataFrame(known, "codespace string, code int, reason string")
    return failures.join(reasons, ["codespace", "code"], "left").withColumn("reason", F.coalesce("reason", F.concat_ws(" ", F.lit("code"), F.col("code").cast("string"), F.col("codespace"))))


def pace(blocks: DataFrame, n: int = 600, least: int = 40, guess: int = 6_000_000) -> DataFrame:
    """Time a block over the last n blocks before each one; a guess until ``least`` are seen."""
    order = Window.partitionBy(F.lit(0)).orderBy("height")  # a row a block of one chain's tip
    back = order.rowsBetween(-n, Window.currentRow)
    seen = F.count(F.lit(1)).over(back) - 1
    span = F.col("at_us") - F.min("at_us").over(back)
    step = (span / F.nullif(F.col("height") - F.min("height").over(back), F.lit(0)))
    return blocks.withColumn("pace_us", F.when(seen < least, F.lit(guess)).otherwise(F.floor(step)).cast("long"))


def readable(publications: DataFrame, checks: DataFrame) -> DataFrame:
    """Promises of which some check reached a server: those that a reading can speak for."""
    reached = checks.where(rules.reached(F.col("verified"), F.col("tcp_ok"), F.col("outcome"))).select("promise_hash")
    return publications.join(reached, "promise_hash", "left_semi")


def shaped(rows: DataFrame, listed: list[str], detail: list[str], whole: bool) -> DataFrame:
    """The columns of a list, or with ``whole`` those of a detail page as well."""
    return rows.select(*listed, *(detail if whole else []))


def resolved(addresses: DataFrame, dimension: DataFrame) -> DataFrame:
    """Addresses in any form (hexadecimal of either case, or bech32 of any prefix) with the validator whose key they name.

    addresses: address. dimension: validator, hex (lower case). An unknown or malformed address has a null validator.
    """
    text = F.trim("address")
    key = F.when(text.rlike("^[0-9a-fA-F]{40}$"), F.lower(text)).otherwise(codecs.from_bech32(text))
    return addresses.withColumn("hex", key).join(dimension.select("validator", "hex"), "hex", "left")
