"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's docs. Stages before the last return the columns of `documents`, whatever
they are. In every stage null texts count as empty ones (near duplicates leaves them alone), repeated rows are alike,
ties go by hashes of id and text, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gramforge.llm import decontam, mixing, neardup, quality, tokens
from gramforge.llm.runtime import Scratch, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality network scores at 0.5 or more; null texts score as empty ones."""
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, network)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one of the least doc_id."""
    return neardup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of a test item."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the schedule places before its weights can no longer be held: sources by their share to the power 0.7.
    Only the selection takes effect here; mix(docs, live_weight=0) would keep every row, at the end out of its weights."""
    return mixing.mix(docs).filter("mixed").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents, read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.tokenize(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: The network and the tokenizer are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    out = stored(STAGES[-1][1](spark, docs, sf_dir), "pipeline")
    scratch.remove()
    return out
