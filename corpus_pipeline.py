"""From raw documents to packed training sequences, stage by stage.

Every stage takes all that its predecessor kept, as a written table, and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.llm import catalog, decontaminate, ngram_join, packing, substring_dedup, toxicity
from prodlens.llm.storage import Stages


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, catalog.table(spark, sf_dir, "labels"), catalog.toxicity_training())


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return ngram_join.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated phrases of 20 words or more go from the texts; every document stays."""
    cleaned = substring_dedup.drop_repeats(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, catalog.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # dictionaries and token ids have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the table ``documents``."""
    stages, docs, before = Stages(spark, "pipeline"), catalog.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stages.write(name, stage(spark, docs, sf_dir))
        if before:
            stages.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
