"""Failed transactions: what their code means in words, which message failed, and whose list they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Registered errors of the public application framework by code, as their modules describe them.
SDK = {
    2: "tx parse error",
    3: "invalid sequence",
    4: "unauthorized",
    5: "insufficient funds",
    6: "unknown request",
    7: "invalid address",
    8: "invalid pubkey",
    9: "unknown address",
    10: "invalid coins",
    11: "out of gas",
    12: "memo too large",
    13: "insufficient fee",
    14: "maximum number of signatures exceeded",
    15: "no signatures supplied",
    16: "failed to marshal JSON bytes",
    17: "failed to unmarshal JSON bytes",
    18: "invalid request",
    19: "tx already in mempool",
    20: "mempool is full",
    21: "tx too large",
    22: "key not found",
    23: "invalid account password",
    24: "tx intended signer does not match the given signer",
    25: "invalid gas adjustment",
    26: "invalid height",
    27: "invalid version",
    28: "invalid chain-id",
    29: "invalid type",
    30: "tx timeout height",
    31: "unknown extension options",
    32: "incorrect account sequence",
    33: "failed packing protobuf message to Any",
    34: "failed unpacking protobuf message from Any",
    35: "internal logic error",
    36: "conflict",
    37: "feature not supported",
    38: "not found",
    39: "Internal IO error",
    40: "error in app.toml",
    41: "invalid gas limit",
}
AUTHZ = {
    2: "authorization not found",
    3: "expiration time of authorization should be more than current time",
    4: "unknown authorization type",
    5: "grant key not found",
    6: "authorization expired",
    7: "grantee and granter should be different",
    9: "authorization can be given to msg with only one signer",
    12: "max tokens should be positive",
}
#: Codes whose registered text would misdescribe them.
OTHERS = {("undefined", 1): "The chain gave this error no code", ("undefined", 111222): "Execution panicked"}
REASONS = {("sdk", k): v[:1].upper() + v[1:] for k, v in SDK.items()} | {("authz", k): v[:1].upper() + v[1:] for k, v in AUTHZ.items()} | OTHERS
#: Versions of the application whose errors the table was checked against.
VERSIONS = (10,)
FAILED_AT = r"^failed to execute message; message index: (0|[1-9][0-9]{0,5}): "


def reason(codespace: Column, code: Column, more: dict[tuple[str, int], str] | None = None) -> Column:
    """The plain wording of a code, null for one that is not listed; ``more`` adds a chain's own modules."""
    known = REASONS | (more or {})
    table = F.create_map(*[F.lit(x) for (space, n), text in known.items() for x in (f"{space}/{n}", text)])
    return F.element_at(table, F.concat_ws("/", codespace, code.cast("string")))


def explained(records: DataFrame, more: dict[tuple[str, int], str] | None = None, versions: Sequence[int] = VERSIONS) -> DataFrame:
    """Records of kind ``failed_txs`` with ``reason`` (null where nothing exact is known) and ``failed_index`` (-1 if the log names no
    message of the transaction). Nothing else in the log is read."""
    checked = F.col("app_version").isin(*versions)
    said = F.regexp_extract(F.coalesce("log", F.lit("")), FAILED_AT, 1)
    index = F.when(said != "", said.cast("int"))
    known = F.exists(F.coalesce("messages", F.array()), lambda m: m["index"] == index)
    return records.withColumns({"reason": F.when(checked, reason(F.col("codespace"), F.col("code"), more)), "failed_index": F.when(checked & F.coalesce(known, F.lit(False)), index).otherwise(-1)})


def kind(types: Column, kinds: dict[str, str]) -> Column:
    """The kind of a transaction from the types of its messages: theirs if they share one, else ``several``; null for none listed.

    ``kinds``: last part of a message type to its kind.
    """
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    found = F.array_distinct(F.filter(F.transform(types, lambda t: F.element_at(table, F.substring_index(t, ".", -1))), lambda k: k.isNotNull()))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).when(F.size(found) > 1, "several")


def listed(records: DataFrame, kinds: dict[str, str], by_signer: Sequence[str] = ()) -> DataFrame:
    """(tx_hash, account, msg_index, kind): the lists that a failed transaction's own messages belong to.

    Only transactions that passed the checks before execution, and messages of a listed kind that are whole; the account is the
    publisher that the message names, or the signer for the kinds ``by_signer``.
    """
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    each = records.where("ante_passed").select("tx_hash", F.explode("messages").alias("m"))
    typed = each.withColumn("kind", F.element_at(table, F.substring_index("m.type_url", ".", -1)))
    account = F.when(F.col("kind").isin(*by_signer), F.col("m.signer")).otherwise(F.col("m.detail.publisher")) if by_signer else F.col("m.detail.publisher")
    whole = ~F.coalesce("m.cut", F.lit(False)) & F.col("m.detail").isNotNull()
    rows = typed.where(F.col("kind").isNotNull() & whole).select("tx_hash", account.alias("account"), F.col("m.index").alias("msg_index"), "kind")
    return rows.where("account <> ''")
