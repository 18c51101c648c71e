"""Corpus preparation in five stages, each with one of the operators of graphloom.llm.

toxicity: documents that the model rejects go. near_duplicates: of each class of linked documents the one with
the smallest id stays (without ids or words: all; of rows with that same id, the first by checksum).
decontamination: documents that contain a benchmark item go. mixing: documents are sampled to
the target weights. sharding: the rest is dealt to 24 shards.

Defined results: null and empty texts are never toxic, near-duplicate or contaminated, and are sampled as cells without
tokens; null ids take part in every stage; rows equal in id and text are one class; very long texts are read whole; empty
labels or benchmarks reject nothing; empty documents give an empty result; further columns, whatever their names,
pass all stages but the last, which returns doc_id, size, text_crc32, shard, slot, lang and source.
What a stage writes on the way is dropped when its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, jaccard, mixing, sharding, toxicity
from graphloom.llm.common import scratch, table

#: Toxicity, near-duplicate classes and sampling have no statement in SQL; tests/llm/test_pipeline.py holds the
#: stages against plain versions.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, 24, carry={"lang": F.col("lang"), "source": F.col("source")}).drop("stratum")


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", remove_benchmark),
    ("mixing", sample_to_targets),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"stage_{name}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
