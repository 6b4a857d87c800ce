"""The corpus pipeline: documents in, packed token sequences out, in five stages.

Each stage works on what the one before kept, written as Parquet and read again, so a lost executor costs
no more than the tasks it had. All but the last return the columns of documents. The tables that a stage
wrote for itself are deleted when its result is there; the stages' results stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import drop_tables, shared_dir, table, written
from cairn.llm.packing import packing_stage
from cairn.llm.pii import pii_stage
from cairn.llm.quality_rules import rules_stage
from cairn.llm.simhash import simhash_stage
from cairn.llm.site_quality import quality_stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_stage(spark, docs, sf_dir)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules_stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_stage(spark, docs, sf_dir)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_stage(spark, docs, sf_dir)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing_stage(spark, docs, sf_dir)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Fitted models and a tokenizer cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/cairn/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        first = written()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        drop_tables(spark, first)
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
