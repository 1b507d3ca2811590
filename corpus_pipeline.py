"""The corpus pipeline: five operators in a row, from raw documents to token ids.

Each stage takes what its predecessor kept, with the columns of `documents`, and its decisions
take effect: the quality classifier and decontamination drop documents, near-duplicate
detection keeps one document of each group, substring dedup shortens texts (n_chars follows),
and the last stage returns token ids with proof of the round trip.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, common, decontam, minhash, quality, substring


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs, percent=80)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short = substring.drop_repeats(docs)
    return short.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else short


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Executors still hold the memory of four stages, so this one remembers less than it could.
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, max_states=120_000)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_spans),
    ("decontamination", drop_benchmark_copies),
    ("byte_bpe", encode_tokens),
]

#: The quality classifier is learned, which SQL can't express; tests compare the stages after it with brute force, row by row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each is written once, as Parquet in the shared folder, and the next reads it from there; what the next has read is deleted."""
    docs = common.table(spark, sf_dir, "documents")
    written = []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return docs
        written.append(common.stored(docs, name))
        docs = spark.read.parquet(written[-1])
        for old in written[-2:-1]:
            common.remove(spark, old)
