"""Payments: totals, series, publishers, namespaces, escrow, withdrawals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.plans.views import DAY

SETTLED = "settlement"


def _if(kind: str, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("long")


def blob_key(publications: DataFrame) -> DataFrame:
    """promise_hash and the key its blob has over all promises: version and commitment."""
    return publications.select("promise_hash", F.concat(F.col("blob_version").cast("string"), F.lit(":"), F.col("commitment").cast("string")).alias("blob_key"))


def totals(payments: DataFrame, publications: DataFrame, start: int, end: int) -> DataFrame:
    """One row of market totals of a window; blobs are told apart by key, or by promise where the key is unknown."""
    inside = payments.where(F.col("at_us").between(start, end)).join(blob_key(publications), "promise_hash", "left")
    settled = F.col("kind") == SETTLED
    key = F.coalesce("blob_key", F.concat(F.lit("promise:"), F.col("promise_hash").cast("string")))
    fees, size = _if("settlement", F.col("amount")), _if("settlement", F.col("blob_size"))
    return inside.agg(
        F.count_if(settled).alias("settlements"), fees.alias("fees"), size.alias("bytes"), F.count_distinct(F.when(settled, F.col("publisher"))).alias("publishers"),
        F.count_distinct(F.when(settled & (F.col("namespace") != ""), F.col("namespace"))).alias("namespaces"), F.count_distinct(F.when(settled, key)).alias("blobs"),
        F.count_if(F.col("kind") == "timeout").alias("timeouts"), _if("timeout", F.col("amount")).alias("timed_out"),
        F.count_if((F.col("kind") == "deposit") & (F.col("denom") == "unit")).alias("deposits"),
        F.round(fees * 1048576.0 / F.nullif(size, F.lit(0)), 6).alias("per_mib"),
    )


def series(payments: DataFrame, step: int) -> DataFrame:
    """Settlements, fees and bytes per step of time that has any."""
    at = F.floor(F.col("at_us") / step).cast("long") * step
    return payments.where(F.col("kind") == SETTLED).groupBy(at.alias("at_us")).agg(F.count(F.lit(1)).alias("settlements"), F.sum("amount").alias("fees"), F.sum("blob_size").alias("bytes"))


def filled(steps: DataFrame, step: int, start: int, end: int) -> DataFrame:
    """A series with a row for every step of [start, end], zeros where nothing was, and a flag on the last, unfinished step."""
    spark = steps.sparkSession
    every = spark.range(start // step, end // step + 1).select((F.col("id") * step).alias("at_us"))
    values = [c for c in steps.columns if c != "at_us"]
    return every.join(steps, "at_us", "left").select("at_us", *[F.coalesce(c, F.lit(0)).alias(c) for c in values], (F.col("at_us") + step > end).alias("partial"))


def publishers(payments: DataFrame, escrow: DataFrame, start: int, end: int) -> DataFrame:
    """One row per publisher of the window: conditional sums, shares, first and last payment ever, escrow where known."""
    inside = payments.where(F.col("at_us").between(start, end)).groupBy("publisher").agg(
        F.count_if(F.col("kind") == SETTLED).alias("settlements"), _if("settlement", F.col("blob_size")).alias("bytes"), _if("settlement", F.col("amount")).alias("fees"),
        F.coalesce(F.max(F.when(F.col("kind") == SETTLED, F.col("blob_size"))), F.lit(0)).alias("largest"), F.count_if(F.col("kind") == "timeout").alias("timeouts"), F.count(F.lit(1)).alias("payments"),
    )
    ever = payments.groupBy("publisher").agg(F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"))
    whole = Window.partitionBy(F.lit(0))
    joined = inside.join(ever, "publisher").join(escrow.where("denom = 'unit' and found").select("publisher", "balance"), "publisher", "left")
    return joined.withColumn("fee_share", F.round(F.col("fees") / F.nullif(F.sum("fees").over(whole), F.lit(0)), 9))


def nested_windows(payments: DataFrame, now: int, days: dict[str, int]) -> DataFrame:
    """Totals of nested windows (a day in a week in a month in all) from one pass: disjoint bands, then running sums."""
    names = list(days)
    band = F.lit(len(names) - 1)
    for k in range(len(names) - 2, -1, -1):
        band = F.when(F.col("at_us") > now - days[names[k]] * DAY, k).otherwise(band)
    bands = payments.where((F.col("at_us") <= now) & (F.col("kind") == SETTLED)).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("fees"))
    every = payments.sparkSession.createDataFrame(list(enumerate(names)), "band int, name string")
    running = Window.partitionBy(F.lit(0)).orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a band
    joined = every.join(bands, "band", "left")
    return joined.select("name", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("settlements"), F.coalesce(F.sum("fees").over(running), F.lit(0)).alias("fees"))


def namespaces(publications: DataFrame, payments: DataFrame, now: int) -> DataFrame:
    """Per namespace: promises and bytes, those of the last day apart, distinct accounts (payer, else publisher), first and last."""
    paid = payments.where(F.col("kind") == SETTLED).select("promise_hash", F.col("publisher").alias("payer"))
    recent = F.col("settled_us") >= now - 30 * DAY
    return publications.join(paid, "promise_hash", "left").groupBy("namespace").agg(
        F.count(F.lit(1)).alias("promises"), F.sum("blob_size").alias("bytes"), F.count_if(recent).alias("recent"), F.coalesce(F.sum(F.when(recent, F.col("blob_size"))), F.lit(0)).alias("recent_bytes"),
        F.count_distinct(F.coalesce("payer", F.col("publisher"))).alias("accounts"), F.min("settled_us").alias("first_us"), F.max("settled_us").alias("last_us"),
    )


def top_namespaces(payments: DataFrame, n: int = 10) -> DataFrame:
    """The first n namespaces of each publisher by settlements, then newest, then name."""
    found = payments.where((F.col("kind") == SETTLED) & (F.col("namespace") != "")).groupBy("publisher", "namespace").agg(F.count(F.lit(1)).alias("settlements"), F.max("at_us").alias("last_us"))
    order = Window.partitionBy("publisher").orderBy(F.desc("settlements"), F.desc("last_us"), "namespace")
    return found.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= n)


def unpaid(publications: DataFrame, payments: DataFrame) -> DataFrame:
    """Settled promises with no payment of either kind on record."""
    return publications.join(payments.where("kind in ('settlement', 'timeout')").select("promise_hash"), "promise_hash", "left_anti")


def timeouts_by_account(payments: DataFrame, prefixes: tuple[str, ...] = ("acc",)) -> DataFrame:
    """Timed-out payments by the account that processed them, its address prefix taken off."""
    bare = F.regexp_replace("processor", f"^({'|'.join(prefixes)})", "")
    return payments.where("kind = 'timeout'").groupBy(bare.alias("account")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


def charges(payments: DataFrame) -> DataFrame:
    """Per promise what was settled and what timed out."""
    return payments.where("kind in ('settlement', 'timeout')").groupBy("promise_hash").agg(_if("settlement", F.col("amount")).alias("settled"), _if("timeout", F.col("amount")).alias("timed_out"))


def resolve_withdrawals(gone: DataFrame, payouts: DataFrame) -> DataFrame:
    """What became of withdrawals that left the queue: executed, consumed or unattributed.

    A payout is attributed only where one withdrawal and one payout could be each other's alone; nothing is guessed.
    """
    early = F.col("gone_us") < F.col("available_us")
    pay = payouts.select(F.col("publisher"), F.col("amount"), F.col("dedupe_key").alias("payout"), F.col("height").alias("paid_height"), F.col("at_us").alias("paid_us"))
    fits = F.col("paid_height").between(F.col("last_seen_height") + 1, F.col("gone_height")) & (F.col("paid_us") >= F.col("available_us"))
    pairs = gone.where(~early).join(pay, ["publisher", "amount"]).where(fits)
    pairs = pairs.withColumn("__payouts", F.count(F.lit(1)).over(Window.partitionBy("publisher", "requested_at"))).withColumn("__claims", F.count(F.lit(1)).over(Window.partitionBy("payout")))
    sure = pairs.where("__payouts = 1 and __claims = 1").select("publisher", "requested_at", "payout")
    joined = gone.join(sure, ["publisher", "requested_at"], "left")
    return joined.withColumn("outcome", F.when(early, "consumed").when(F.col("payout").isNotNull(), "executed").otherwise("unattributed"))


def open_withdrawals(escrow: DataFrame, withdrawals: DataFrame, now: int) -> DataFrame:
    """Escrow accounts with their pending withdrawals summed."""
    pending = withdrawals.where(F.col("gone_us") > now).groupBy("publisher").agg(F.count(F.lit(1)).alias("pending"), F.sum("amount").alias("pending_amount"), F.min("available_us").alias("next_us"))
    return escrow.join(pending, "publisher", "left").select("publisher", "balance", F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("pending_amount", F.lit(0)).alias("pending_amount"))

