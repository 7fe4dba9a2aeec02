"""A corpus pipeline of four filters and a packer, each of them an operator of ``weftline.llm``.

Defined results of all stages: an empty table gives none; a null, empty or blank text fails the base rules of the first;
rows that share an id go or stay together, and a row without an id is judged by its own text in the first stage, stays in
the next two and is packed as any other; equal rows stay or go alike; columns beside those named stay as they are; texts may
have any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decon, jaccard, packing, quality, secretscan
from weftline.llm.common import Scratch, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no risk-controlled rule rejects."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.near_duplicates_removed(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decon.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    return secretscan.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in bins of the permitted lengths."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: The Jaccard join and the lexing of secrets are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read again, and goes once the next is written."""
    tmp = Scratch(spark, "pipeline")
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = tmp.write(stage(spark, docs, sf_dir), name)
        if before:
            tmp.drop(before)
        before = name
    return docs
