"""Corpus pipeline: five stages over documents, each written and read again before the next.

Language identification drops documents without a known language, near-duplicate detection keeps one
document of each class, decontamination drops documents with benchmark items, personal data is
replaced by its kind, and what is left is packed into sequences.

Cases: a null text, one without a letter, and every document where no language can be learned goes with the first stage; of
equal documents, repeated rows and equal ids with equal texts one stays; an empty table gives no piece; an empty benchmark drops nothing;
very long texts are read whole in every stage; further columns are carried up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from public_tokenizers import path

from judgeloom.llm import decontam, langid, minhash, packing, pii
from judgeloom.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs, path("word_bpe_49k.json")))


STAGES = [("language", language), ("near-duplicates", deduplicate), ("decontamination", decontaminate), ("personal data", private), ("packing", pack)]

#: Trained models, hashed registers and tokenizers can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
