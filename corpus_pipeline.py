"""From raw documents to token counts: five stages, each one operator of lodestone.llm on all rows that the
stage before it kept, written as Parquet and read again in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, mixing, pii, quality, simhash
from lodestone.llm.common import shared_folder
from lodestone.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines of the kept ones are removed."""
    return quality.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities and telling terms are generalised or removed."""
    return pii.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy."""
    return bpe.encode_decode(docs, *tokenizer(), with_ids=False)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("pii", personal_data), ("mixing", mix), ("byte-level bpe", tokenize)]
#: Hashes, fingerprints and tokens are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            out.write.parquet(f"{folder}/{n}")
            out = spark.read.parquet(f"{folder}/{n}")
        docs = out
    return docs
