"""From documents to packed sequences: quality rules, toxicity, near-dedup, packing.

Each stage is (name, function of (spark, docs, sf_dir)); all but the last return the columns of their
input. run() chains them over `documents`, cutting the lineage after each with a reliable checkpoint; that
of the stage before is deleted then.

Nulls: a null text is an empty text, which the quality rules reject. Tied members of a duplicate
group: the smallest doc_id stays; of rows that share it (or have none), one. Very long texts are judged,
compared and packed whole. Further columns are carried to the packing, whatever their names, but never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import packing, quality_rules, simhash, toxicity
from siltstone.llm.common import bucket, checkpointed, forget, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_rows(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where(bucket("doc_id", 3) != 1).select("doc_id", "toxic")
    return toxicity.kept_rows(docs, toxicity.learn(docs, labels, "toxic"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.distinct_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, packing.default_vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-dedup", dedup_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, checkpointed(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
