"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

1. Every text becomes its set of word shingles (64-bit hashes), a 128-bit digest of the set and a signature: ``CHUNKS *
   WIDTH`` symbols of 16 bits, which are indexed, and ``SKETCH`` more of 8 bits. Equal sets are one class from here on.
2. The indexed symbols are split into chunks. Two signatures that differ in fewer than ``2 * CHUNKS`` of them have, by the
   pigeonhole principle, a chunk with at most one wrong symbol, so each chunk is indexed once for every symbol
   that may be wrong (that symbol left out). All pairs under that distance therefore meet under some key; a pair
   beyond it is still missed with probability (1 - 0.835)**12 < 5e-10 at a similarity of 0.85, 2e-7 at 0.8.
3. Keys with the same classes count once. The classes of a key are compared by the Hamming distance of their whole
   signatures, in tiles that meet pairwise; a pair that differs in more than ``FARTHEST`` of all symbols, or whose sizes
   rule a link out, is dropped, which a pair of similarity 0.8 is with probability under 1e-9. So texts that only share a
   part, however many they are, go no further. Of the pairs that are left a tile emits a spanning forest.
4. The components of these forests are the candidate clusters, cut into tiles of texts; every two tiles of a cluster meet
   in one task, which counts all their intersections exactly over the full sets and emits a spanning forest of the true
   links. Components of those links give the result.

Nothing is capped: a key of n classes is n / SIGN_TILE tiles of signatures, a cluster n / TILE tiles of texts, which meet
pairwise. No hot key is gathered: keys are reduced by partial aggregates and joined back, where Spark may split them.

Defined results: null and empty texts and texts of white space have an empty set, are linked with nothing and
kept; with fewer words than a shingle has, the whole sequence is the one shingle; rows that share an id count as
one document (the links of all its rows); a row without an id is linked with nothing, has no component and is
kept; long texts are read whole; an empty table gives an empty result; extra columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm.components import components
from tallyspan.llm.shared import loosened, table, written

CHUNKS, WIDTH = 12, 5
SYMBOLS = CHUNKS * WIDTH
#: Symbols that are only compared, and the most of all symbols in which a pair may differ.
SKETCH = 132
FARTHEST = 76
#: Classes in a tile of signatures and in a tile of texts; a task holds two tiles at a time.
SIGN_TILE, TILE = 1024, 512

_seeds = np.random.default_rng(20).integers(0, 2**64, (2, SYMBOLS + SKETCH), dtype=np.uint64)
_TIMES, _PLUS = _seeds[0] | np.uint64(1), _seeds[1]
_MARKS = np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of so many words, A-Z in lower case."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1 + len(found))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    last = len(found) - words + 1
    rolled = hashed[:last].copy()
    for k in range(1, words):
        rolled = _mixed(rolled * _A + hashed[k : k + last])
    return np.unique(rolled)


def digest(members: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    if not len(members):
        return 0, 0
    value = xxhash.xxh3_128_digest(members.tobytes())
    return int.from_bytes(value[:8], "little", signed=True), int.from_bytes(value[8:], "little", signed=True)


def signature(members: np.ndarray) -> bytes:
    """16 or 8 bits of the smallest member under each of the hash functions."""
    least = np.full(SYMBOLS + SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 512):
        np.minimum(least, (members[at : at + 512, None] * _TIMES + _PLUS).min(0), out=least)
    bits = _mixed(least)
    return bits[:SYMBOLS].astype("<u2").tobytes() + bits[SYMBOLS:].astype("u1").tobytes()


def symbols(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The indexed symbols and the others, a row a signature."""
    rows = np.frombuffer(b"".join(signatures), "u1").reshape(len(signatures), 2 * SYMBOLS + SKETCH)
    return rows[:, : 2 * SYMBOLS].copy().view("<u2"), rows[:, 2 * SYMBOLS :]


def distances(signatures: list[bytes]) -> np.ndarray:
    """The number of symbols in which every two signatures differ."""
    total = np.zeros((len(signatures), len(signatures)), np.uint8)
    for part in symbols(signatures):
        for column in np.ascontiguousarray(part.T):
            total += column[:, None] != column[None, :]
    return total


def profiler(words: int):
    """(doc_id, text) to (doc_id, n_shingles, d1, d2, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, signs = [], [], [], []
            for text in batch.column(1):
                members = shingles(text.as_py(), words)
                d1, d2 = digest(members)
                sizes.append(len(members))
                first.append(d1)
                second.append(d2)
                signs.append(signature(members) if len(members) else b"")
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d1", "d2", "signature"])

    return run


def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, signature) to (key, class_id): each chunk once for every symbol that may be wrong.

    A key is a mixed form of chunk number, left-out place and the other symbols; mixing is one to one over the
    64 bits of the symbols, and a clash of numbers could only add candidates.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        signs = symbols(batch.column(1).to_pylist())[0].reshape(n, CHUNKS, WIDTH).astype(np.uint64)
        keys = []
        for c in range(CHUNKS):
            for left_out in range(WIDTH):
                value = np.zeros(n, np.uint64)
                for k in range(WIDTH):
                    if k != left_out:
                        value = (value << np.uint64(16)) | signs[:, c, k]
                keys.append(_mixed(value + _MARKS[c * WIDTH + left_out]))
        ids = np.tile(batch.column(0).to_numpy(), CHUNKS * WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids)], names=["key", "class_id"])


def intersections(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Exact sizes of all pairwise intersections, as products of 0/1 slices over the shared members."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    several = (count > 1)[place]
    column, row = shared[place[several]], owner[several]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, min(width, int(column[-1]) + 1 - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        total += part @ part.T
    return total


def spanning(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric table of links: (id, smallest id it reaches here)."""
    np.fill_diagonal(linked, True)
    left, edges = np.ones(len(ids), bool), []
    for root in np.argsort(ids):
        if not left[root]:
            continue
        reached = np.zeros(len(ids), bool)
        new = reached.copy()
        new[root] = True
        while new.any():
            reached |= new
            new = linked[new].any(0) & ~reached
        left &= ~reached
        edges += [(int(i), int(ids[root])) for i in ids[reached] if i != ids[root]]
    return edges


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links with ``100 * intersection >= percent * union``."""
    if len(ids) < 2:
        return []
    both = intersections(sets).astype(np.float64)
    sizes = np.asarray([len(s) for s in sets], np.float64)
    return spanning(ids, 100.0 * both >= percent * (sizes[:, None] + sizes[None, :] - both))


def near_forest(rows: list[tuple[int, int, bytes]], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of (class_id, size, signature) under the distance whose sizes allow a link."""
    if len(rows) < 2:
        return []
    ids, sizes = np.asarray([r[0] for r in rows], np.int64), np.asarray([r[1] for r in rows], np.int64)
    near = distances([r[2] for r in rows]) <= FARTHEST
    return spanning(ids, near & (100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes)))


def by_tiles(edges_of, values: tuple[str, ...]):
    """Rows sorted by (cluster, low, high), two tiles of a cluster, to the edges (a, b) that ``edges_of`` their values gives."""

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in ("cluster", "low", "high")), strict=True)
            for now, value in zip(keys, zip(*(batch.column(n) for n in values), strict=True), strict=True):
                if now != key:
                    found += edges_of(rows)
                    key, rows = now, []
                rows.append(tuple(x.as_py() for x in value))
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        yield batch_of(found + edges_of(rows))

    return run


def verifier(words: int, percent: int):
    """Texts of two tiles to a spanning forest of their true links."""

    def edges_of(rows: list[tuple]) -> list[tuple[int, int]]:
        known: dict[tuple, np.ndarray] = {}
        for class_id, d1, d2, text in rows:
            if (class_id, d1, d2) not in known and digest(members := shingles(text, words)) == (d1, d2):
                known[class_id, d1, d2] = members
        return forest(np.asarray([k[0] for k in known], np.int64), [*known.values()], percent)

    return by_tiles(edges_of, ("class_id", "d1", "d2", "text"))


def tiled(members: DataFrame, size: int) -> DataFrame:
    """Rows with a cluster and its number of classes, once for each two tiles that meet: ``low`` and ``high``."""
    cut = members.withColumn("__tiles", F.ceil(F.col("n") / size).cast("int"))
    cut = cut.withColumn("__tile", F.pmod(F.xxhash64("class_id"), F.col("__tiles")).cast("int"))
    met = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)).alias("__other"))
    met = met.withColumns({"low": F.least("__tile", "__other"), "high": F.greatest("__tile", "__other")}).drop("n", "__tile", "__tiles", "__other")
    return met.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "class_id")


def near_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Spanning forests (a, b) of the classes under the distance, for every key of the index."""
    keys = classes.select("class_id", "signature").mapInArrow(index, "key long, class_id long")
    shared = keys.groupBy("key").agg(F.min("class_id").alias("first"), F.max("class_id").alias("last")).where("first < last")
    shared = written(keys.join(shared.select(loosened(F.col("key")).alias("key")), "key"), "keys")
    # keys with equal classes stand for one group: a pair of near copies shares many
    marks = [F.bit_xor(F.xxhash64("class_id", F.lit(1))).alias("mark1"), F.sum(F.shiftright(F.xxhash64("class_id", F.lit(2)), 32)).alias("mark2")]
    groups = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("first"), F.max("class_id").alias("last"), *marks)
    one = groups.groupBy("n", "first", "last", "mark1", "mark2").agg(F.min("key").alias("key")).select(loosened(F.col("key")).alias("key"), "n")
    members = shared.join(one, "key").select("class_id", F.col("key").alias("cluster"), "n")
    signed = members.join(classes.select("class_id", "size", "signature"), "class_id")
    return tiled(signed, SIGN_TILE).mapInArrow(by_tiles(lambda rows: near_forest(rows, percent), ("class_id", "size", "signature")), "a long, b long")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept (doc_id = component_id)."""
    source = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    profiles = written(source.mapInArrow(profiler(words), "doc_id long, n_shingles long, d1 long, d2 long, signature binary"), "profiles")
    present = profiles.where("n_shingles > 0 and doc_id is not null")
    one = present.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.min("n_shingles").alias("size"), F.min("signature").alias("signature"))
    classes = written(one, "classes")
    clusters = components(near_pairs(classes, percent), "clusters")

    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    members = clusters.join(sizes.select(loosened(F.col("label")).alias("label"), "n"), "label").select(F.col("node").alias("class_id"), F.col("label").alias("cluster"), "n")
    texts = members.join(classes.select("class_id", "d1", "d2"), "class_id").join(source, F.col("class_id") == F.col("doc_id")).drop("doc_id")
    links = tiled(texts, TILE).mapInArrow(verifier(words, percent), "a long, b long")
    # rows of one id with different sets are one document
    own = present.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "class_id"), ["d1", "d2"]).where("doc_id <> class_id").select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    return _labelled(profiles, components(links.unionByName(own), "links"))


def _labelled(profiles: DataFrame, found: DataFrame) -> DataFrame:
    joined = profiles.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("label", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of one document of each group, with the columns of ``documents``."""
    judged = near_duplicates(documents, id_column, text_column, words, percent)
    dropped = judged.where(~F.col("kept")).select(F.col("doc_id").alias("__dropped")).distinct()
    return documents.join(dropped, F.col(id_column).cast("long") == F.col("__dropped"), "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)

