"""Row assignment: counts from stake as Columns, the rows themselves from a seeded permutation of the promise's key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tallyspan.functions.streams import shuffled

#: Numbers that a Python worker draws or returns at once, but for a single larger permutation.
CELLS = 1 << 20


@dataclass(frozen=True)
class Params:
    """Rows are clamp(ceil(original * power * den / (total power * num)), least, original)."""

    least: int = 2
    numerator: int = 1
    denominator: int = 3

    def count(self, original: Column, power: Column, total: Column) -> Column:
        up = original.cast("decimal(38,0)") * power * self.denominator
        down = total.cast("decimal(38,0)") * self.numerator
        rows = F.floor((up + down - 1) / down).cast("long")  # exact: whole numbers well under 38 digits
        return F.least(F.greatest(rows, F.lit(self.least)), original)


def counts(members: DataFrame, params: Params = Params()) -> DataFrame:
    """members: promise_hash, validator, power, original. Adds total power, row_count and the offset in canonical order
    (power descending, validator ascending)."""
    whole = Window.partitionBy("promise_hash")
    before = whole.orderBy(F.desc("power"), "validator").rowsBetween(Window.unboundedPreceding, -1)
    summed = members.withColumn("total", F.sum("power").over(whole))
    counted = summed.withColumn("row_count", params.count(F.col("original"), F.col("power"), F.col("total")))
    return counted.withColumn("offset", F.coalesce(F.sum("row_count").over(before), F.lit(0)))


def seed_of(value: int) -> bytes:
    return hashlib.sha256(str(value).encode()).digest()


def permutations(keys: set[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The permutation that each (commitment, total_rows) seeds; keys of like sizes are drawn together, in bounded memory."""
    ordered, found, at = sorted(keys, key=lambda k: k[1]), {}, 0
    while at < len(ordered):
        end = at + 1
        while end < len(ordered) and end - at < 512 and (end + 1 - at) * ordered[end][1] <= CELLS:
            end += 1
        part = ordered[at:end]
        drawn = shuffled([seed_of(commitment) for commitment, _ in part], [total for _, total in part])
        found.update(zip(part, (np.asarray(p, np.int32) for p in drawn), strict=True))
        at = end
    return found


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(commitment, total_rows, row_count, offset, ...) with the assigned ``rows``: a slice of the permutation from the offset on,
    wrapping round. Batches are cut so that their permutations and slices have about ``CELLS`` numbers.
    """
    known: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        counts = [max(n or 0, 0) if key[1] > 0 else 0 for n, key in zip(batch.column(2).to_pylist(), keys, strict=True)]
        offsets = batch.column(3).to_pylist()
        at = 0
        while at < len(keys):
            end, cells = at, 0
            while end < len(keys) and (end == at or cells + counts[end] + keys[end][1] <= CELLS):
                cells += counts[end] + keys[end][1]
                end += 1
            wanted = {key for key, n in zip(keys[at:end], counts[at:end], strict=True) if n}
            known = {key: known[key] for key in wanted & known.keys()} | permutations(wanted - known.keys())
            parts = [known[keys[k]][(offsets[k] + np.arange(counts[k])) % keys[k][1]] for k in range(at, end) if counts[k]]
            ends = np.cumsum([0, *counts[at:end]], dtype=np.int32)
            rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns, rows], names=[*batch.schema.names, "rows"])
            at = end


def assign(members: DataFrame, blobs: DataFrame, params: Params = Params()) -> DataFrame:
    """Each member's rows: a slice of its promise's permutation from its offset on, wrapping round.

    blobs: promise_hash, commitment, total_rows. Permutations are drawn where a promise's members are and never stored, sent or
    joined: they are far larger than what seeds them. One that promises share is drawn once for those beside each other.
    A blob without rows assigns none.
    """
    sized = blobs.withColumn("total_rows", F.col("total_rows").cast("int")).where("commitment is not null and total_rows is not null")
    first = ["commitment", "total_rows", "row_count", "offset"]
    joined = counts(members, params).join(sized.hint("merge"), "promise_hash")  # as many as promises: no broadcast
    joined = joined.select(*first, *[c for c in joined.columns if c not in first])
    return joined.mapInArrow(slices, StructType([*joined.schema.fields, StructField("rows", ArrayType(IntegerType()))]))


def verify(got: Column, assigned: Column) -> Column:
    """exact, subset, foreign or none: what returned row indices are, against the assigned ones."""
    return F.when(F.size(got) == 0, "none").when(F.array_sort(got) == F.array_sort(assigned), "exact").when(F.size(F.array_except(got, assigned)) == 0, "subset").otherwise("foreign")
