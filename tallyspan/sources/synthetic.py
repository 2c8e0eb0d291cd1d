"""Generated records with known truth: seeded, the same on every run, of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.plans.views import DAY


def chance(seed: int, *parts: str | Column) -> Column:
    """A fixed number from 0 to 1 for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(p) if isinstance(p, str) else p for p in parts]), F.lit(1 << 40)) / F.lit(float(1 << 40))


def promises(spark: SparkSession, n: int, seed: int = 1, days: int = 30, window_days: int = 14) -> DataFrame:
    """n promises spread over days, each kept for a window."""
    rows = spark.range(n).withColumnRenamed("id", "promise_hash")
    settled = F.floor(chance(seed, "promise_hash") * days * DAY).cast("long")
    out = rows.select("promise_hash", settled.alias("settled_us"))
    return out.withColumns({"must_serve_us": F.col("settled_us") + window_days * DAY, "needed_rows": F.lit(8).cast("long"), "excess_rows": F.lit(0).cast("long"), "held": F.lit(False)})


def checks(pledged: DataFrame, validators: int, seed: int = 1, broken: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """One full reading of every promise near its end by every validator, and the truth: how each obligation ends.

    A validator breaks a promise with the given chance and then answers NOT_FOUND; otherwise it serves its rows.
    """
    pairs = pledged.withColumn("validator", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(validators - 1).cast("long"))))
    failed = chance(seed + 1, "promise_hash", "validator") < broken
    at = F.col("must_serve_us") - 600_000_000
    made = pairs.withColumns({
        "fails": failed, "scheduled_us": at, "started_us": at, "label": F.lit("full"), "assigned": F.lit(True), "attested": F.lit(True), "phase": F.lit("in_window"), "tls_ok": F.lit(True), "tcp_ok": F.lit(True),
        "attempt_owed": F.lit(False), "subset_of_own": F.lit(True), "rows_returned": F.when(failed, 0).otherwise(4).cast("long"), "first_row": F.col("validator") * 4, "outcome": F.when(failed, "NOT_FOUND").otherwise("SERVED_OK"),
        "verified": ~failed, "cls": F.when(failed, "FAULT").otherwise("HEALTHY"), "dedupe_key": F.concat_ws("|", "promise_hash", "validator"),
    })
    truth = made.groupBy("validator").agg(F.count(F.lit(1)).alias("total"), F.count_if("fails").alias("broken"), F.count_if(~F.col("fails")).alias("served"))
    return made.drop("fails"), truth


def text_of(us: str) -> Column:
    """Microseconds as a record's time."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def publication_lines(promised: DataFrame, assigned: DataFrame) -> DataFrame:
    """Record lines (value) of promises and their assignments, as a scanner writes them."""
    members = F.struct(F.col("validator").cast("string").alias("address"), F.col("row_count").cast("int").alias("row_count"), "attested", "host_at_settlement")
    each = assigned.groupBy("promise_hash").agg(F.array_sort(F.collect_list(members)).alias("validators"))
    joined = promised.join(each, "promise_hash", "left")
    excess = F.col("excess_rows").cast("int")
    record = F.struct(
        F.lit(3).alias("schema_version"), F.col("promise_hash").cast("string").alias("promise_hash"), F.col("height").alias("settlement_height"), text_of("settled_us").alias("settlement_time"),
        F.col("tx_index").alias("settlement_tx_index"), F.col("tx_code").alias("settlement_tx_code"), F.col("publisher").cast("string").alias("signer"),
        F.struct(F.col("promise_height").alias("height"), "namespace", "blob_size", "blob_version", F.col("commitment").cast("string").alias("commitment"), text_of("created_us").alias("creation_timestamp")).alias("promise"),
        text_of("must_serve_us").alias("must_serve_until"),
        F.struct(F.struct(F.col("needed_rows").cast("int").alias("original_rows")).alias("protocol_params"), (excess + 5).alias("sigma"), F.lit(5).alias("distinct"), F.col("validators").alias("validators")).alias("assignment"),
    )
    return joined.select(F.explode(F.array(F.to_json(record))).alias("value"))


def measurement_lines(made: DataFrame) -> DataFrame:
    """Record lines (value) of checks, as a prober writes them. The key of a check is its vantage here, so keys order alike."""
    rows = F.when(F.col("rows_returned") > 0, F.sequence(F.col("first_row"), F.col("first_row") + F.col("rows_returned") - 1))
    shadow = F.when(F.col("shadowed"), "other"), F.when(F.col("shadow_uncertain"), "gap")
    record = F.struct(
        F.lit(3).alias("schema_version"), F.col("dedupe_key").alias("vantage"), F.col("promise_hash").cast("string").alias("promise_hash"), F.col("validator").cast("string").alias("validator_address"),
        "assigned", "attested", "attestation_unknown", F.col("label").alias("schedule_label"), text_of("scheduled_us").alias("scheduled_at"), text_of("started_us").alias("started_at"), text_of("started_us").alias("finished_at"),
        F.when(F.col("attempt_owed"), text_of("started_us")).alias("next_attempt_due"), F.struct(F.col("tcp_ok").alias("ok")).alias("tcp"), F.struct(F.col("tls_ok").alias("ok")).alias("tls"),
        F.struct(F.col("identity_stale").alias("stale")).alias("identity"), F.struct(F.col("pin_stale")).alias("observer"),
        F.struct(F.col("rows_returned").cast("int").alias("rows_returned"), rows.alias("row_indices"), F.col("rows_verify").alias("commitment_verified"), F.col("subset_of_own").alias("rows_subset_of_assignment"), shadow[0].alias("shadowed_by"), shadow[1].alias("shadow_gap")).alias("download"),
        "outcome",
    )
    return made.select(F.explode(F.array(F.to_json(record))).alias("value"))
