"""The corpus pipeline: five stages, each over all that the one before it kept.

Quality rules drop what the policy rejects; exact deduplication leaves the largest doc_id of equal texts;
near-duplicate detection leaves one document of each class; mixing writes documents at fitted rates; the last
stage encodes them. All but the last return the columns of documents.

A stage that needs the labels table reads it from sf_dir. A document that mixing writes several times stays
several rows, with the same doc_id.

Defined results: null and empty texts have too few words and go with the quality rules; very long texts are read in
whole by every stage; rows of equal text go by their place in the files where ids are equal or missing; rows without
an id are outlived by those with one; further columns pass through all stages but the last, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickweave.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from tickweave.llm.base import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, mixing.mix(docs, mixing.quality_domains(table(spark, sf_dir, "labels"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(docs.select("doc_id", "text"), path))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte-level BPE", encode)]
#: The fitted rates and sampled similarities can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
