"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Toxic documents go; of linked near copies the smallest doc_id stays; passages that an
earlier document has are cut; documents with benchmark windows go; the rest is packed.

Defined cases: a stage judges every row by itself, so null and repeated doc_ids are fine; null
and empty texts are never toxic, near copies or contaminated, and give one piece each; without
labels nothing is toxic; other columns, whatever their names, pass through to the last stage;
empty tables give an empty result. Scratch tables of a stage go when its result is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tarifa.llm import common, decontam, jaccard, packing, substring, toxicity


#: Near copies share this percentage of their n-grams of so many words; the op8 query has its own contract.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.stage(docs, common.table(spark, sf_dir, "labels"))


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.stage(docs, NEAR_WORDS, NEAR_PERCENT)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.stage(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.stage(docs, common.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_near_copy),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: A trained classifier, a tokenizer and subset-sum packing aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    where = f"{common.scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{where}/{k}-{name}"
        with common.released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
