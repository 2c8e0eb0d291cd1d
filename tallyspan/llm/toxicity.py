"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Training takes at most ``TRAIN_ROWS`` labelled rows, those whose hashed ids come first, and never a held-out
row (crc32 of the id as text, modulo 4, is 2). A lexicon of words and word beginnings, at most ``LEXICON_ENTRIES`` of
either, is learned from one fold for the features of the other, so the trees see honest densities; scores of trees
trained without a row calibrate that row's fold. Scoring then reads every whole text once, without a shuffle.

Inputs of a score are features of the text alone: lexicon densities and weights, closeness of lexicon words to
second-person words, capitals, punctuation, obfuscated spellings, length.

Defined results: null and empty texts get the score of a text without words; repeated rows get equal scores; with
no usable label every score is 0.5 of prior odds; an empty table gives an empty result; extra columns of the input
are not carried along.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.llm.boosting import Boosted, Isotonic, sigmoid
from tallyspan.llm.shared import table

#: Most labelled rows that training reads.
TRAIN_ROWS = 6000
THRESHOLD = 0.3
#: Most words, and most word beginnings, that a lexicon holds: those of the largest weight.
LEXICON_ENTRIES = 3000
REMEMBERED = 120_000
#: Words that a lexicon word may stand from a second-person word to count as close.
CLOSE = 4

# Second-person words of the corpus languages.
SECOND_PERSON = set("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
# Characters commonly written for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

FEATURES = (
    "words", "lexicon_hits", "lexicon_density", "prefix_hits", "prefix_density", "weight_max", "weight_sum", "weight_mean",
    "near_person", "capitals", "punctuation", "bangs", "symbols", "digits", "obfuscated", "obfuscated_hits",
)


def bare(word: str) -> str:
    """A word in lower case without signs at its ends."""
    return word.lower().strip("\"'`.,;:!?()[]{}<>|#*$%&-_~…«»“”’")


def plain(word: str) -> str:
    """A spelling with look-alike characters and stretched letters undone and inner signs dropped."""
    return re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[^\w]|_", "", word.translate(LOOKALIKES)))


@dataclass
class Lexicon:
    """Log-odds weights of words and of word beginnings, from document counts with smoothing."""

    words: dict[str, float]
    starts: dict[str, float]

    @classmethod
    def learn(cls, texts: list[str], labels: np.ndarray, most: int = LEXICON_ENTRIES) -> Lexicon:
        counts: tuple[Counter, ...] = (Counter(), Counter(), Counter(), Counter())  # words and starts, all and toxic
        for text, toxic in zip(texts, labels, strict=True):
            seen = {b for w in set(text.split()) if (b := bare(w))}
            starts = {w[:k] for w in seen for k in (4, 5, 6, 7) if len(w) > k}
            counts[0].update(seen)
            counts[1].update(starts)
            if toxic:
                counts[2].update(seen)
                counts[3].update(starts)
        base = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5

        def chosen(every: Counter, bad: Counter, least: int) -> dict[str, float]:
            odds = {}
            for word, n in bad.items():
                if n >= least:
                    p = (n + 2 * base) / (every[word] + 2)
                    weight = float(np.log(p / (1 - p)) - np.log(base / (1 - base)))
                    if weight > 1.5:
                        odds[word] = weight
            return dict(sorted(odds.items(), key=lambda x: (-x[1], x[0]))[:most])

        return cls(chosen(counts[0], counts[2], 3), chosen(counts[1], counts[3], 4))


class Weighing(dict):
    """Remembers of each spelling: None if nothing is special, else (word weight, start weight, flags)."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self.look(word)
        if len(word) < 48:
            self[word] = value
        return value

    def look(self, word: str):
        core = bare(word)
        if core in SECOND_PERSON:
            return (0.0, 0.0, "person")
        known = self.lexicon.words.get(core, 0.0)
        start = max((self.lexicon.starts.get(core[:k], 0.0) for k in (4, 5, 6, 7) if len(core) > k), default=0.0)
        odd = False
        if core and not core.isalpha() and any(c.isalpha() for c in core) or re.search(r"(.)\1\1", core):
            undone = plain(core)
            odd = undone != core
            if odd and not known and len(undone) > 2 and (found := self.lexicon.words.get(undone, 0.0)) > 0:
                return (found, start, "hidden")
        if known or start or odd:
            return (known, start, "odd" if odd else "")
        return None


def features(text: str | None, weighing: Weighing) -> list[float]:
    found = text.split() if text else []
    n = len(found)
    special = [(i, v) for i, v in enumerate(map(weighing.__getitem__, found)) if v is not None]
    hits = [(i, v) for i, v in special if v[0] > 0]
    starts = [v[1] for _, v in special if v[1] > 0]
    persons = np.asarray([i for i, v in special if v[2] == "person"])
    near = 0
    if len(persons):
        for i, _ in hits:
            k = np.searchsorted(persons, i)
            near += any(abs(int(persons[j]) - i) <= CLOSE for j in (k - 1, k) if 0 <= j < len(persons))
    chars = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128) if text else np.zeros(128)
    total = max(1, int(chars.sum()))
    upper, lower = chars[65:91].sum(), chars[97:123].sum()
    weights = [v[0] for _, v in hits]
    per = max(1, n)
    return [
        np.log1p(n), np.log1p(len(hits)), len(hits) / per, np.log1p(len(starts)), len(starts) / per,
        max([0.0, *weights, *starts]), sum(weights), sum(weights) / per, np.log1p(near),
        upper / max(1, upper + lower), sum(chars[list(b".,;:?!")]) / total, chars[33] / total, sum(chars[list(b"#*$%&|<>")]) / total, chars[48:58].sum() / total,
        sum(v[2] == "odd" for _, v in special) / per, np.log1p(sum(v[2] == "hidden" for _, v in special)),
    ]


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    @classmethod
    def train(cls, texts: list[str], labels: np.ndarray) -> Model:
        """Two folds by position; each fold's lexicon describes the other, each fold's trees calibrate the other."""
        fold = np.arange(len(texts)) % 2
        x = np.zeros((len(texts), len(FEATURES)))
        for k in (0, 1):
            weighing = Weighing(Lexicon.learn([t for t, f in zip(texts, fold, strict=True) if f != k], labels[fold != k]))
            for i in np.flatnonzero(fold == k):
                x[i] = features(texts[i], weighing)
        scores = np.zeros(len(texts))
        for k in (0, 1):
            scores[fold == k] = Boosted().fit(x[fold != k], labels[fold != k])(x[fold == k])
        return cls(Lexicon.learn(texts, labels), Boosted().fit(x, labels), Isotonic().fit(sigmoid(scores), labels))

    def score(self, texts: list[str | None], weighing: Weighing) -> np.ndarray:
        x = np.asarray([features(t, weighing) for t in texts]).reshape(-1, len(FEATURES))
        raw = sigmoid(self.trees(x))
        return np.clip(0.999 * self.calibration(raw) + 0.001 * raw, 0, 1)  # the raw part orders equal steps


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``rows`` labelled rows that are not held out; which ones depends on the hashed id alone.

    An id's label is its largest one, its text the smallest of its texts, so repeated rows change nothing.
    """
    usable = labels.where(~held_out(F.col("doc_id")) & F.col(label_column).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.groupBy("doc_id").agg(F.max(label_column).alias("__label"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    wanted = [r["doc_id"] for r in picked.collect()]  # rows at most
    texts = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("__text"))
    joined = texts.join(F.broadcast(picked), "doc_id") if wanted else texts.limit(0).withColumn("__label", F.lit(0))
    known = sorted((zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["t"], r["y"]) for r in joined.groupBy("doc_id").agg(F.min("__text").alias("t"), F.max("__label").alias("y")).collect())
    return Model.train([r[2] for r in known], np.asarray([float(r[3]) for r in known]))


_weighings: dict[int, Weighing] = {}


def scorer(model: Model):
    """(doc_id, text) to (doc_id, score)."""
    mark = zlib.crc32(repr((sorted(model.lexicon.words.items()), sorted(model.lexicon.starts.items()))).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _weighings:
            _weighings.clear()
            _weighings[mark] = Weighing(model.lexicon)
        for batch in batches:
            scores = model.score([t.as_py() for t in batch.column(batch.num_columns - 1)], _weighings[mark])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(scorer(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(documents: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with the columns of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighing = Weighing(model.lexicon)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column))
            scores = model.score([t.as_py() for t in texts], weighing)
            yield batch.filter(pa.array(scores < threshold))

    return documents.mapInArrow(run, documents.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels")))
