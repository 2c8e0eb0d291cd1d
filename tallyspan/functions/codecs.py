"""Address codecs: bech32 (the public BIP 173 format) to and from hexadecimal, and blob keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The format's alphabet and the coefficients of its checksum.
LETTERS = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def checksum(values: list[int]) -> int:
    state = 1
    for v in values:
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATOR):
            if top >> i & 1:
                state ^= g
    return state


def regroup(values: list[int], have: int, want: int, pad: bool) -> list[int] | None:
    """Numbers of ``have`` bits as numbers of ``want`` bits; without padding, leftover bits must be zero."""
    held, bits, out = 0, 0, []
    for v in values:
        held, bits = held << have | v, bits + have
        while bits >= want:
            bits -= want
            out.append(held >> bits & (1 << want) - 1)
    if pad and bits:
        out.append(held << want - bits & (1 << want) - 1)
    elif not pad and (bits >= have or held & (1 << bits) - 1):
        return None
    return out


def spread(prefix: str) -> list[int]:
    return [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]


def encode(prefix: str, data: bytes) -> str:
    values = regroup([*data], 8, 5, True) or []
    tail = checksum(spread(prefix) + values + [0] * 6) ^ 1
    return prefix + "1" + "".join(LETTERS[v] for v in values + [tail >> 5 * (5 - i) & 31 for i in range(6)])


def decode(text: str) -> tuple[str, bytes] | None:
    """Prefix and bytes, or None for mixed case, a foreign letter or a wrong checksum."""
    if text != text.lower() and text != text.upper():
        return None
    prefix, one, rest = text.lower().rpartition("1")
    if not one or not prefix or len(rest) < 6 or any(c not in LETTERS for c in rest):
        return None
    values = [LETTERS.index(c) for c in rest]
    if checksum(spread(prefix) + values) != 1:
        return None
    data = regroup(values[:-6], 5, 8, False)
    return None if data is None else (prefix, bytes(data))


def to_bech32(prefix: str):
    @F.pandas_udf("string")
    def convert(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: encode(prefix, bytes.fromhex(k)), na_action="ignore")

    return convert


def from_bech32(address: Column) -> Column:
    """The hexadecimal key of an address of any prefix; null if it is none."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: found[1].hex() if (found := decode(t)) else None, na_action="ignore")

    return convert(address)
