"""From records to facts: the columns that classes, readings, obligations and load need, taken from parsed record lines.

Times become microseconds. A row list stays a list: its distinct rows are counted only where cheap bounds leave a reading open
(see ``readings``). Records that answer for others (amendments, uncertainties) become the overlays of ``checks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.operators.checks import amended, classified
from tallyspan.sources.records import canonical, dedupe_key, micros

#: From this version of a measurement on its ``attested`` can be relied on.
ATTESTATION_VERSION = 2


def _us(name: str) -> Column:
    return micros(canonical(F.col(name)))


def publications(records: DataFrame) -> DataFrame:
    """One row per promise, from records of kind ``publications``."""
    sized = F.coalesce("assignment.protocol_params.original_rows", F.lit(0)).cast("long")
    return records.select(
        "promise_hash", F.col("signer").alias("publisher"), _us("settlement_time").alias("settled_us"), _us("promise.creation_timestamp").alias("created_us"),
        F.col("settlement_height").alias("height"), F.col("settlement_tx_index").cast("long").alias("tx_index"), F.col("promise.height").alias("promise_height"),
        F.col("promise.blob_size").alias("blob_size"), F.col("promise.commitment").alias("commitment"), F.col("promise.blob_version").alias("blob_version"),
        _us("must_serve_until").alias("must_serve_us"), sized.alias("needed_rows"), (F.col("assignment.sigma") - F.col("assignment.distinct")).cast("long").alias("excess_rows"),
        F.col("promise.namespace").alias("namespace"), F.coalesce("settlement_tx_code", F.lit(0)).alias("tx_code"),
    )


def assignments(records: DataFrame) -> DataFrame:
    """One row per promise and validator, from records of kind ``publications``."""
    each = records.select("promise_hash", F.explode("assignment.validators").alias("a"))
    return each.select("promise_hash", F.col("a.address").alias("validator"), F.col("a.row_count").cast("long").alias("row_count"), F.col("a.rows").alias("rows"), F.col("a.attested").alias("attested"), F.col("a.host_at_settlement").alias("host_at_settlement"))


def uncertain(records: DataFrame) -> DataFrame:
    """Height ranges in which params are not certain, from records of kind ``param_uncertainty``: the newest of each id; it holds
    verdicts until it is resolved."""
    newest = records.groupBy("id").agg(F.max_by(F.struct("from_height", "to_height", "resolution", "after"), F.struct(F.coalesce("resolved_at", F.lit("")), "detected_at")).alias("r"))
    days = (F.col("r.after.shard_retention_seconds") / 86_400).cast("long")
    return newest.select("id", "r.from_height", "r.to_height", F.col("r.resolution").isNull().alias("holds"), days.alias("retention_days"))


def checks(records: DataFrame) -> DataFrame:
    """One row per check, from records of kind ``measurements``, not yet classified."""

    def true(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    scheduled, given = canonical(F.col("scheduled_at")), F.coalesce("download.shadowed_by", F.lit("")) != ""
    return records.select(
        dedupe_key(F.col("vantage"), F.col("promise_hash"), F.col("validator_address"), scheduled, F.coalesce("attempt", F.lit(0))).alias("dedupe_key"),
        "vantage", "promise_hash", F.col("validator_address").alias("validator"), _us("scheduled_at").alias("scheduled_us"), _us("started_at").alias("started_us"), _us("finished_at").alias("finished_us"),
        F.col("schedule_label").alias("label"), "outcome", true("assigned").alias("assigned"), true("attested").alias("attested"),
        (true("attestation_unknown") | (F.coalesce("schema_version", F.lit(0)) < ATTESTATION_VERSION)).alias("attestation_unknown"),
        given.alias("shadowed"), (~given & (F.coalesce("download.shadow_gap", F.lit("")) != "")).alias("shadow_uncertain"), true("identity.stale").alias("identity_stale"),
        true("download.rows_subset_of_assignment").alias("subset_of_own"), true("observer.pin_stale").alias("pin_stale"), true("download.commitment_verified").alias("rows_verify"),
        true("tls.ok").alias("tls_ok"), true("tcp.ok").alias("tcp_ok"), F.col("next_attempt_due").isNotNull().alias("attempt_owed"),
        F.coalesce("download.rows_returned", F.lit(0)).cast("long").alias("rows_returned"), F.col("download.row_indices").alias("row_indices"),
        F.greatest(F.lit(0), -F.coalesce("clock_offset_ms", F.lit(0)) * 1000).alias("behind_us"),
    )


def amendments(records: DataFrame) -> DataFrame:
    """Late verdicts, from records of kind ``amendments``: the newest of each check."""
    key = ["promise_hash", "validator", "scheduled_us"]
    rows = records.select("promise_hash", F.col("validator_address").alias("validator"), _us("scheduled_at").alias("scheduled_us"), F.col("to").alias("to_class"), canonical(F.col("judged_at")).alias("at"))
    return rows.groupBy(*key).agg(F.max_by("to_class", F.struct("at", "to_class")).alias("to_class"))


def recomputed(publication_records: DataFrame, measurement_records: DataFrame, uncertainty_records: DataFrame | None = None, amendment_records: DataFrame | None = None, tolerance: int = 150_000_000) -> DataFrame:
    """Classified checks from nothing but records: phases and classes are worked out again, not taken from the lines."""
    known = publications(publication_records)
    if uncertainty_records is None:
        ranges = known.limit(0).select(F.col("height").alias("from_height"), F.col("height").alias("to_height"), F.lit(True).alias("holds"))
    else:
        ranges = uncertain(uncertainty_records)
    rows = classified(checks(measurement_records), known, ranges, tolerance)
    return rows if amendment_records is None else amended(rows, amendments(amendment_records)).drop("first_cls")


def differing(recomputed_rows: DataFrame, measurement_records: DataFrame) -> DataFrame:
    """Checks whose recorded phase or class is not the recomputed one: dedupe_key, both phases and both classes."""
    key = dedupe_key(F.col("vantage"), F.col("promise_hash"), F.col("validator_address"), canonical(F.col("scheduled_at")), F.coalesce("attempt", F.lit(0)))
    said = measurement_records.select(key.alias("dedupe_key"), F.col("phase").alias("recorded_phase"), F.col("classification").alias("recorded_cls"))
    joined = recomputed_rows.select("dedupe_key", "phase", "cls").join(said, "dedupe_key")
    return joined.where(~F.col("phase").eqNullSafe(F.col("recorded_phase")) | ~F.col("cls").eqNullSafe(F.col("recorded_cls")))
