"""From raw documents to token ids: toxicity, exact and near duplicates, benchmark leaks, encoding.

Each stage works on all rows its predecessor kept, and is written as Parquet before the next
reads it. The filtering stages keep whole rows with the columns of ``documents``; nulls in
any column, repeated rows and further columns pass through as their operators define. An
empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, common, decontaminate, exact_dedup, simhash, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentences stays below the threshold; learnt from the labels' training folds."""
    return toxicity.keep_rows(docs, toxicity.train(docs, common.load(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest id."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at a similarity of 0.8 on five-word shingles the row of the smallest id."""
    return simhash.near_duplicates(docs, shingle=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was verified."""
    return decontaminate.keep_rows(docs, common.load(spark, sf_dir, "benchmark"))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    got = bpe.encode_decode(docs, VOCABULARY)
    return got.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("encoding", to_ids),
]

#: SimHash and learnt scores have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
