"""A training-data pipeline: five stages over documents, each written before the next one reads it.

1. Quality rules: documents that the rules reject go.
2. Near duplicates by min-max hashing, shingles of five words, similarity 0.8: one document of each group stays.
3. Personal data is masked.
4. Sources are mixed to their target weights: a document appears as often as the mix takes it.
5. Texts are encoded by byte-level BPE and decoded again.

The first four return the columns of documents, whatever further columns these have. Null texts count as empty
and fall to the quality rules; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quorica.llm import bpe, minhash, mixing, pii, quality_rules
from quorica.llm.common import prepared
from quorica.llm.queries import TOKEN_RANKS
from quorica.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return minhash.drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded text and the number of tokens."""
    prepared(spark)
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path(TOKEN_RANKS), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, vocabulary).selectExpr("doc_id", "ids", "size(ids) AS n_tokens", "cast(decoded AS string) AS text")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("personal_data", mask_personal_data),
    ("source_mixing", mix_sources),
    ("byte_level_bpe", tokens),
]
# Masking and encoding have no SQL form; tests hold the rows against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a folder."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        path = f"{root}/{place}_{name}"
        done.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
