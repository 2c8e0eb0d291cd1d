"""Record files: one JSON object a line, read with fixed schemas; archives, exports, range files, label files.

Batch readers never infer a schema. A line counts as read only if it ends with a newline: a torn last line is left for
the next read. Lines that are too long or no JSON are counted, not dropped silently.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest line that is read (64 MiB).
LONGEST = 64 * 1024 * 1024

_STEP = """STRUCT<
    attempted: BOOLEAN,
    ok: BOOLEAN,
    duration_ms: BIGINT,
    detail: STRING,
    error: STRING
>"""
_PARAMS = """STRUCT<
    withdrawal_delay: STRING,
    payment_promise_timeout: STRING,
    payment_promise_height_window: BIGINT,
    shard_retention: STRING,
    full_stake_storage_budget: BIGINT,
    withdrawal_delay_seconds: BIGINT,
    payment_promise_timeout_seconds: BIGINT,
    shard_retention_seconds: BIGINT,
    effective_from_height: BIGINT,
    effective_from_tx_index: INT,
    source: STRING
>"""
_MESSAGE = """STRUCT<
    index: INT,
    type_url: STRING,
    signer: STRING,
    detail: STRUCT<
        publisher: STRING,
        promise_hash: STRING,
        namespace: STRING,
        blob_size: BIGINT,
        amount: STRING,
        host: STRING,
        validator: STRING
    >,
    cut: BOOLEAN
>"""

# The fields of the record formats.
SCHEMAS = {
    "publications": f"""
        schema_version INT,
        promise_hash STRING,
        settlement_height BIGINT,
        settlement_time STRING,
        settlement_tx_hash STRING,
        settlement_tx_index INT,
        settlement_tx_code BIGINT,
        signer STRING,
        validator_signature_count INT,
        promise STRUCT<
            chain_id: STRING,
            height: BIGINT,
            namespace: STRING,
            namespace_version: SMALLINT,
            namespace_id: STRING,
            blob_size: BIGINT,
            blob_version: BIGINT,
            commitment: STRING,
            creation_timestamp: STRING,
            signer_public_key: STRING,
            signature: STRING
        >,
        params_at_publication {_PARAMS},
        must_serve_until STRING,
        must_serve_until_basis STRING,
        must_serve_until_ambiguous BOOLEAN,
        assignment STRUCT<
            error: STRING,
            protocol_params: STRUCT<
                original_rows: INT,
                total_rows: INT
            >,
            total_voting_power: BIGINT,
            validator_set_height: BIGINT,
            sigma: INT,
            distinct: INT,
            validators: ARRAY<STRUCT<
                address: STRING,
                voting_power: BIGINT,
                row_count: INT,
                rows: ARRAY<INT>,
                attested: BOOLEAN,
                host_at_settlement: STRING
            >>
        >,
        recorded_at STRING
    """,
    "measurements": f"""
        schema_version INT,
        vantage STRING,
        promise_hash STRING,
        commitment STRING,
        must_serve_until STRING,
        validator_address STRING,
        validator_host STRING,
        assigned BOOLEAN,
        attested BOOLEAN,
        attestation_unknown BOOLEAN,
        assigned_row_count INT,
        schedule_label STRING,
        scheduled_at STRING,
        started_at STRING,
        finished_at STRING,
        lateness_ms BIGINT,
        attempt INT,
        next_attempt_due STRING,
        shared_from STRING,
        dns {_STEP},
        tcp {_STEP},
        tls STRUCT<
            attempted: BOOLEAN,
            ok: BOOLEAN,
            duration_ms: BIGINT,
            version: STRING,
            cipher_suite: STRING,
            peer_cert_sha256: STRING,
            error: STRING
        >,
        identity STRUCT<
            attempted: BOOLEAN,
            ok: BOOLEAN,
            duration_ms: BIGINT,
            reason: STRING,
            stale: BOOLEAN,
            error: STRING
        >,
        download STRUCT<
            attempted: BOOLEAN,
            ok: BOOLEAN,
            duration_ms: BIGINT,
            rows_returned: INT,
            rows_expected: INT,
            row_indices: ARRAY<BIGINT>,
            rows_sha256: STRING,
            bytes_returned: BIGINT,
            commitment_verified: BOOLEAN,
            assignment_verified: BOOLEAN,
            rows_subset_of_assignment: BOOLEAN,
            shadowed_by: STRING,
            shadow_gap: STRING,
            error: STRING
        >,
        clock_offset_ms BIGINT,
        observer STRUCT<
            pin_stale: BOOLEAN
        >,
        phase STRING,
        outcome STRING,
        classification STRING,
        classification_reason STRING,
        raw_error STRING,
        total_duration_ms BIGINT
    """,
    "payments": """
        schema_version INT,
        dedupe_key STRING,
        kind STRING,
        height BIGINT,
        time STRING,
        tx_hash STRING,
        tx_index INT,
        msg_index INT,
        publisher STRING,
        processor STRING,
        promise_hash STRING,
        namespace STRING,
        blob_size BIGINT,
        gas_units BIGINT,
        denom STRING,
        amount_utia DECIMAL(20,0),
        available_at STRING,
        recorded_at STRING
    """,
    "host_history": """
        from_height BIGINT,
        from_tx_index INT,
        cons_address STRING,
        host STRING,
        source STRING,
        time STRING
    """,
    "registry": """
        kind STRING,
        validator_cons_address STRING,
        host STRING,
        height BIGINT,
        at STRING,
        reason STRING
    """,
    "runs": """
        kind STRING,
        component STRING,
        vantage STRING,
        version STRING,
        pid INT,
        hostname STRING,
        at STRING,
        config MAP<STRING, STRING>,
        reason STRING
    """,
    "sampling_decisions": """
        schema_version INT,
        kind STRING,
        vantage STRING,
        promise_hash STRING,
        commitment STRING,
        settlement_time STRING,
        must_serve_until STRING,
        decided_at STRING,
        reason STRING,
        points ARRAY<STRUCT<
            schedule_label: STRING,
            scheduled_at: STRING,
            phase: STRING
        >>,
        validators INT
    """,
    "sampling-secrets": """
        day DATE,
        commitment STRING,
        secret STRING,
        revealed_at STRING
    """,
    "amendments": """
        dedupe_key STRING,
        promise_hash STRING,
        validator_address STRING,
        scheduled_at STRING,
        from STRING,
        to STRING,
        reason STRING,
        shadowed_by STRING,
        judged_at STRING,
        scanner_frontier STRING,
        prune_tolerance_s BIGINT
    """,
    "corrections": """
        schema_version INT,
        kind STRING,
        uncertainty_id STRING,
        promise_hash STRING,
        from_must_serve_until STRING,
        to_must_serve_until STRING,
        vantage STRING,
        dedupe_key STRING,
        validator_address STRING,
        scheduled_at STRING,
        from_classification STRING,
        to_classification STRING,
        reason STRING,
        judged_at STRING
    """,
    "param_uncertainty": f"""
        schema_version INT,
        id STRING,
        chain_id STRING,
        kind STRING,
        from_height BIGINT,
        to_height BIGINT,
        effective_from_height BIGINT,
        interval_start_known BOOLEAN,
        before {_PARAMS},
        after {_PARAMS},
        detected_at STRING,
        to_time STRING,
        resolution STRING,
        resolved_at STRING
    """,
    "failed_txs": f"""
        schema_version INT,
        dedupe_key STRING,
        height BIGINT,
        time STRING,
        app_version BIGINT,
        tx_hash STRING,
        tx_index INT,
        code BIGINT,
        codespace STRING,
        log STRING,
        log_cut BOOLEAN,
        gas_wanted BIGINT,
        gas_used BIGINT,
        ante_passed BOOLEAN,
        fee STRING,
        messages ARRAY<{_MESSAGE}>,
        recorded_at STRING
    """,
    "tx_costs": f"""
        schema_version INT,
        dedupe_key STRING,
        height BIGINT,
        tx_index INT,
        time STRING,
        tx_hash STRING,
        gas_wanted BIGINT,
        gas_used BIGINT,
        fee STRING,
        fee_payer STRING,
        messages ARRAY<{_MESSAGE}>,
        recorded_at STRING
    """,
    "state": f"""
        schema_version INT,
        chain_id STRING,
        start_height BIGINT,
        last_scanned_height BIGINT,
        last_scanned_time STRING,
        param_history ARRAY<STRUCT<
            from_height: BIGINT,
            from_tx_index: INT,
            source: STRING,
            params: {_PARAMS}
        >>,
        gaps ARRAY<STRUCT<
            from: BIGINT,
            to: BIGINT,
            reason: STRING,
            at: STRING,
            host_events_read: BOOLEAN
        >>
    """,
}
SCHEMAS["reachability"] = SCHEMAS["measurements"]

#: The field that dates a line of each file.
DATED_BY = {
    "publications": "settlement_time", "measurements": "started_at", "reachability": "started_at", "payments": "time", "host_history": "time", "registry": "at", "runs": "at", "sampling_decisions": "decided_at",
    "sampling-secrets": "revealed_at", "amendments": "judged_at", "corrections": "judged_at", "param_uncertainty": "detected_at", "failed_txs": "time", "tx_costs": "time",
}


def canonical(time: Column) -> Column:
    """RFC 3339 UTC text with nine fractional digits: texts of one length, ordered and compared as they are."""
    whole = F.regexp_extract(time, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?Z$", 1)
    part = F.regexp_extract(time, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?Z$", 2)
    sound = (whole != "") & F.try_to_timestamp(F.concat(whole, F.lit("Z"))).isNotNull()  # a day that the calendar has
    return F.when(sound, F.concat(whole, F.lit("."), F.rpad(part, 9, "0"), F.lit("Z")))


def micros(time: Column) -> Column:
    """Microseconds of a canonical text; the last three digits are dropped, so equality keeps to the text."""
    return F.unix_micros(F.try_to_timestamp(F.concat(F.substring(time, 1, 26), F.lit("Z"))))


def dedupe_key(vantage: Column, promise: Column, validator: Column, scheduled: Column, attempt: Column) -> Column:
    base = F.concat_ws("|", vantage, promise, validator, scheduled)
    return F.when(attempt > 0, F.concat_ws("|", base, attempt.cast("string"))).otherwise(base)


def parsed(lines: DataFrame, kind: str) -> DataFrame:
    """Lines (value, and whatever else) as records: ``record``, the ``raw`` line, and ``bad`` for what is none."""
    text = F.col("value")
    record = F.from_json(text, SCHEMAS[kind] + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # exploded from an array of one, so that a line is parsed once, however many fields are taken from it
    marked = lines.select("*", F.explode(F.array(F.when(F.length(text) <= LONGEST, record))).alias("record"))
    bad = F.col("record").isNull() | F.col("record._bad").isNotNull()
    return marked.withColumn("bad", bad).withColumnRenamed("value", "raw")


def read_lines(spark: SparkSession, paths: str | list[str], whole_lines: bool = False) -> DataFrame:
    """Lines of record files, plain or gzipped, with the file each comes from.

    ``whole_lines``: files are read whole to find and leave out a last line without a newline; for live files only.
    """
    if not whole_lines:
        return spark.read.text(paths).where("length(value) > 0").withColumn("file", F.col("_metadata.file_path"))
    files = spark.read.text(paths, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    complete = F.regexp_extract("value", r"(?s)^(.*)\n[^\n]*$", 1)
    return files.select("file", F.explode(F.split(complete, "\n")).alias("value")).where("length(value) > 0").select("value", "file")


def read_records(spark: SparkSession, paths: str | list[str], kind: str, live: bool = False) -> DataFrame:
    """Good records of files, one column a field, with ``raw`` and ``file``."""
    rows = parsed(read_lines(spark, paths, live), kind).where("not bad")
    return rows.select("record.*", "raw", "file").drop("_bad")


def bad_lines(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """How many lines of each file are no records."""
    return parsed(read_lines(spark, paths), kind).groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("bad"))


def vantage_of(file: Column) -> Column:
    """The vantage in a path like .../vantages/<name>/reachability.jsonl."""
    return F.nullif(F.regexp_extract(file, r"/vantages/([^/]+)/[^/]+$", 1), F.lit(""))


def own_network(records: DataFrame, known: DataFrame, tip_height: int, seconds: int) -> tuple[DataFrame, DataFrame]:
    """Records of a known validator and of a height not past what the chain can have, and the others."""
    marked = records.join(known.select(F.col("validator").alias("validator_address")).distinct().withColumn("__known", F.lit(True)), "validator_address", "left")
    ours = F.coalesce("__known", F.lit(False)) & (F.coalesce("height", F.lit(0)) <= tip_height + seconds + 100_000)
    return marked.where(ours).drop("__known"), marked.where(~ours).drop("__known")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["state"]).json(path, multiLine=True)


def segmented(spark: SparkSession, archives: list[str], live: str) -> DataFrame:
    """Lines of archived segments and then of the live file, with the segment's number for order."""
    parts = [read_lines(spark, path).withColumn("segment", F.lit(k)) for k, path in enumerate(archives)]
    parts.append(read_lines(spark, live, True).withColumn("segment", F.lit(len(archives))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_ranges(spark: SparkSession, path: str, separator: str, columns: str) -> DataFrame:
    """Range files (start, end, ...), plain or gzipped; addresses as exact numbers, ``v6`` telling the family.

    Lines whose ends are no addresses of one family are left out.
    """
    rows = spark.read.csv(path, sep=separator, comment="#", schema=columns, mode="PERMISSIVE")
    numbered = rows.withColumns({"first": address_number(F.col("start")), "last": address_number(F.col("end")), "v6": F.col("start").contains(":"), "line": F.monotonically_increasing_id()})
    return numbered.where(F.col("first").isNotNull() & F.col("last").isNotNull() & (F.col("start").contains(":") == F.col("end").contains(":")))


def address_number(address: Column) -> Column:
    """An IPv4 or IPv6 address as a decimal number; null for anything else."""
    @F.pandas_udf("string")
    def number(texts: pd.Series) -> pd.Series:
        from ipaddress import ip_address

        def one(text: str) -> str | None:
            try:
                return str(int(ip_address(text.strip())))
            except ValueError:
                return None

        return texts.map(one, na_action="ignore")

    return number(address).cast("decimal(38,0)")  # an IPv6 address past 10**38 is no longer exact and comes out null


def routable(address: Column) -> Column:
    """Whether an address is public: no loopback, private, link-local, multicast or unspecified one."""
    @F.pandas_udf("boolean")
    def public(texts: pd.Series) -> pd.Series:
        from ipaddress import ip_address

        def one(text: str | None) -> bool:
            try:
                return bool(text) and ip_address(text.strip()).is_global and not ip_address(text.strip()).is_multicast
            except ValueError:
                return False

        return texts.map(one)

    return public(address)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Members of export archives (tar.gz): archive, member, lines, sha256, and the lines themselves, one row a line.

    Each archive is unpacked in one task; archives are a day's records.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    for member in tar:
                        if member.isfile():
                            data = tar.extractfile(member).read()
                            lines = data.decode(errors="replace").splitlines()
                            digest = hashlib.sha256(data).hexdigest()
                            n = max(1, len(lines))
                            values = [[archive] * n, [member.name] * n, [digest] * n, lines or [None]]
                            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in values], names=["archive", "member", "sha256", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "archive string, member string, sha256 string, value string")


def verified_exports(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """Members against a manifest (member, lines, sha256): ok, changed, missing or extra."""
    found = members.groupBy("member").agg(F.count("value").alias("got_lines"), F.first("sha256").alias("got_sha256"))
    joined = found.join(manifest, "member", "full_outer")
    state = F.when(F.col("got_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("got_lines") == F.col("lines")) & (F.col("got_sha256") == F.col("sha256")), "ok").otherwise("changed")
    return joined.withColumn("state", state)


def read_labels(spark: SparkSession, text: str) -> DataFrame:
    """A label file: a ``publishers:`` list of flat ``- key: value`` entries (address, label, source, url)."""
    entries: list[dict[str, str]] = []
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#") or bare == "publishers:":
            continue
        if bare.startswith("- "):
            entries.append({})
            bare = bare[2:].strip()
        key, colon, value = bare.partition(":")
        if not colon or not entries:
            raise ValueError(f"not a label line: {line!r}")
        entries[-1][key.strip()] = value.strip().strip("\"'")
    names = ("address", "label", "source", "url")
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], ", ".join(f"{n} string" for n in names))


def to_line(record: dict) -> str:
    return json.dumps(record, separators=(",", ":"), ensure_ascii=False)
