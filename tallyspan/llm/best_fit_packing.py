"""Best-fit packing by length histogram: plan over counts of lengths, then join documents to planned slots.

1. Every text becomes token ids plus a separator id; longer documents are cut into full windows. Only sizes
   and checksums leave this step, as a written table.
2. A histogram of piece lengths (at most ``window`` rows) goes to the driver. Best-fit decreasing runs over
   its counts: equal bins are kept as runs, so the plan's size follows the number of lengths, not of documents.
3. Pieces get a rank within their length in two levels (inside hash groups, then group offsets), and find their
   slot in the plan by rank. No length, however common, is sorted or gathered in one task.

Defined results: a null or empty text is a document of the separator alone; repeated rows are packed as
separate documents; an empty table gives an empty result; extra columns are not carried along; texts of any
length are tokenized whole, in memory that grows with one text.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspan.llm.shared import table, written

WINDOW = 2048
SEPARATOR = 0
#: Distinct spellings in a generation of a Python worker's memory; it holds two, and a full one replaces the older.
REMEMBERED = 250_000
#: Pieces that one ranking group holds on average.
GROUP_ROWS = 2_000
#: Deflate level of the token ids of a piece, which are written once and shuffled twice before they lie in their sequence.
DEFLATE = 6

PLACED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
NAMES = ("doc_id", "piece", "start", "length", "ids_crc32", "salt", "ids")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Spellings(dict):
    """Maps a word between white space to its ids as little-endian 32-bit bytes, and remembers them.

    The vocabulary never joins tokens over white space, so a text's ids are its words' ids in order. Words of
    plain Latin letters, digits and signs are cut by the vocabulary's own pattern here and go straight to its
    merge table; any other word, and one that holds an added token such as ``<|endoftext|>``, goes through the whole
    tokenizer.
    """

    # Fixed value: the vocabulary's splitting pattern, over lower-cased ASCII and Latin-1 letters.
    CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
    PLAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    #: Controls that Python takes for white space and the vocabulary does not.
    ODD = regex.compile("[\x1c-\x1f]")

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # tokens that are looked for in the text before anything else is done to it
        added = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(added)) if added else None
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        spelled = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
        return struct.pack(f"<{len(t := self.model.tokenize(spelled))}I", *[x.id for x in t])

    def spelled(self, word: str) -> bytes:
        if self.added and self.added.search(word):
            return self.whole(word)
        if word.isascii() and word.isalpha() and word.islower():
            return self.part(word)
        if not self.PLAIN.fullmatch(word):
            return self.whole(word)
        parts = self.CUT.findall(word.lower())
        return self.part(word) if parts == [word] else b"".join(map(self.__getitem__, parts))

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.spelled(word)
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        return self.whole(text) if self.ODD.search(text) else b"".join(map(self.__getitem__, text.split()))


_spellings: dict[str, Spellings] = {}


def spellings(vocabulary: str) -> Spellings:
    """One per Python worker, kept from task to task."""
    if vocabulary not in _spellings:
        _spellings[vocabulary] = Spellings(vocabulary)
    return _spellings[vocabulary]


@cache
def id_bytes(vocabulary: str, separator: int = SEPARATOR) -> int:
    """Bytes that hold any id of the vocabulary: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(), separator + 1) <= 1 << 16 else 4


def cut(vocabulary: str, window: int, separator: int, ids_width: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tokenizes (doc_id, text, salt) rows into pieces of ``window`` tokens at most; with their ids, in so many bytes each and deflated, if asked."""
    end, with_ids = np.asarray([separator], "<u4").tobytes(), ids_width > 0
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())[: 7 if with_ids else 6]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(NAMES[: len(kinds)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spellings(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, salt in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids = known.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * window)):
                    part = ids[at : at + 4 * window]
                    rows.append((doc_id.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part), salt.as_py(), *([zlib.compress(np.frombuffer(part, "<u4").astype(f"<u{ids_width}").tobytes(), DEFLATE)] if with_ids else [])))
                    if len(rows) >= 4096:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    return run


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs (length, first rank, count, first bin, offset, in each bin): the pieces of that length with
    ranks from ``first rank`` on fill consecutive bins, ``in each bin`` of them side by side from ``offset``.
    Bins of one free size are runs of consecutive numbers, so a step never looks at single bins.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free size -> runs (first bin, bins)
    sizes: list[int] = []  # ascending keys of free
    runs, bins = [], 0

    def put(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in free:
                free[size] = []
                sizes.insert(bisect_left(sizes, size), size)
            free[size].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                size = sizes[k]
                first, count = free[size].pop()
                if not free[size]:
                    del free[size], sizes[k]
            else:
                each = window // length
                size, first, count = window, bins, -(-left // each)
                bins += count
            each = size // length
            full = min(count, left // each)
            if full:
                runs.append((length, rank, full * each, first, window - size, each))
                put(size - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:  # fewer are left than one more bin could take
                runs.append((length, rank, left, first + full, window - size, left))
                put(size - left * length, first + full, 1)
                full, left = full + 1, 0
            put(size, first + full, count - full)
    return runs


def place(runs: list[tuple[int, int, int, int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds sequence and offset to (..., length, rank) rows by a search among the runs of that length."""
    ordered = np.asarray(sorted(runs), np.int64).reshape(-1, 6)
    by = {int(n): ordered[ordered[:, 0] == n] for n in np.unique(ordered[:, 0])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                mine = by[int(n)]
                r = mine[np.searchsorted(mine[:, 1], rank[at], "right") - 1]
                ahead = rank[at] - r[:, 1]
                sequence[at] = r[:, 3] + ahead // r[:, 5]
                offset[at] = r[:, 4] + ahead % r[:, 5] * n
            names = [*NAMES[:6]]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def ranked(pieces: DataFrame, groups: int) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each length, without gathering a length in one task."""
    inner = Window.partitionBy("length", "group").orderBy("salt", "doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    grouped = pieces.withColumn("group", F.pmod("salt", F.lit(groups)))
    starts = grouped.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n")).select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = grouped.withColumn("place", F.row_number().over(inner) - 1)
    return local.join(starts, ["length", "group"]).select("doc_id", "piece", "start", "length", "ids_crc32", "salt", (F.col("first") + F.col("place")).alias("rank"))


def pieces_of(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, vocabulary: str | None = None, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """The table of all pieces, written; ``salt`` is a number of its own for each row of ``documents``."""
    salt = F.monotonically_increasing_id()
    source = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), salt.alias("salt"))
    vocabulary = vocabulary or default_vocabulary()
    cutter = cut(vocabulary, window, separator, id_bytes(vocabulary, separator) if with_ids else 0)
    return written(source.mapInArrow(cutter, PIECES + (", ids binary" if with_ids else "")), "pieces")


def placed(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with their sequence_id and offset (place there), and ``salt``."""
    pieces = pieces.select(*NAMES[:6])
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # window rows at most
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    groups = 1 + sum(histogram.values()) // GROUP_ROWS
    return ranked(pieces, groups).mapInArrow(place(plan(histogram, window)), f"{PIECES}, sequence_id long, offset long")


def pack(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, vocabulary: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset (its place there)."""
    return placed(pieces_of(documents, id_column, text_column, window, vocabulary, separator), window).select(*PLACED)


def sequences(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, vocabulary: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """The packed sequences themselves: sequence_id, its token ids, at most ``window`` of them, and its parts in order.

    Ids are little-endian bytes, ``id_bytes`` each: 2 where the vocabulary allows it. As pieces they are deflated, as they are
    shuffled twice.

    A part has doc_id, row_key (a number of its own for each row of ``documents``), piece, start, length and offset.
    Ids need not be unique. Every text is tokenized once: the ids wait in the table of pieces for their places.
    """
    pieces = pieces_of(documents, id_column, text_column, window, vocabulary, separator, with_ids=True)
    places = placed(pieces, window).select("salt", "piece", "sequence_id", "offset")
    parts = pieces.join(places, ["salt", "piece"])
    in_order = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", F.col("salt").alias("row_key"), "piece", "start", "length"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(zlib.decompress(x["ids"]) for x in row) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], names=["sequence_id", "ids", "parts"])

    kind = "array<struct<offset: long, doc_id: long, row_key: long, piece: int, start: long, length: long>>"
    split = in_order.select("sequence_id", F.transform("all", lambda x: F.struct(x["ids"].alias("ids"))).alias("ids"), F.transform("all", lambda x: x.dropFields("ids")).alias("parts"))
    return split.mapInArrow(run, f"sequence_id long, ids binary, parts {kind}")


def digests(packed: DataFrame) -> DataFrame:
    """The rows of ``pack`` and ``row_key`` from the sequences themselves, checksums of the token ids that lie there."""
    fields = ("doc_id", "row_key", "piece", "start", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sequence, raw, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.frombuffer(raw, f"<u{len(raw) // sum(p['length'] for p in parts)}").astype("<u4").tobytes()
                rows += [(*(p[f] for f in fields), zlib.crc32(ids[4 * p["offset"] : 4 * (p["offset"] + p["length"])]), sequence, p["offset"]) for p in parts]
            kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5)
            columns = zip(*rows, strict=True) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*fields, "ids_crc32", "sequence_id", "offset"])

    return packed.select("sequence_id", "ids", "parts").mapInArrow(run, "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

