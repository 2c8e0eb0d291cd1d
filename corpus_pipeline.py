"""Corpus pipeline: from documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``documents``. Documents
scored as toxic go, one document of each group of near copies stays (five-word shingles, similarity 0.8 or more),
secrets are replaced in the text, sources are mixed to tempered weights (every document at least once, some again),
and the mixture is packed into sequences of 2048 tokens. These are written as the table ``sequences-...`` in the folder of
intermediate tables; the last stage returns a row for each of their pieces, with checksums of the written token ids.
A repeated document has a ``row_key`` of its own each time, so (row_key, piece) is unique.

``run`` drops every table that a stage wrote for itself as soon as the stage's result is written, and all stages'
results but the last one at the end; the sequences stay as well.

Defined results: rows without an id pass every stage as documents of their own; repeated rows are near copies of one
another and rows of one id one document, of which all rows stay; null and empty texts are no near copies, hold no secrets
and are packed as the separator alone; an empty table gives an empty result; further columns of the documents are carried
to the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspan.llm import best_fit_packing, minhash_near_dedup, secret_scans, source_mixing, toxicity
from tallyspan.llm.shared import scope, table, written

#: Most times that the mixture takes a document of a source.
REPEATS = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_near_dedup.keep_one(docs)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scans.redact(docs, secret_scans.fitted(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mix(docs, repeats=REPEATS).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.digests(written(best_fit_packing.sequences(docs), "sequences", keep=True, codec="zstd"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", replace_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained models and a tokenizer are no SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, each stage written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    with scope(spark) as whole:
        for name, stage in STAGES:
            with scope(spark) as kept:
                docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
        return whole(docs, "stage-packing")
