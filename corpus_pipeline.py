"""A training-data pipeline: stages over documents, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import stages
from claimloom.llm.common import load, materialize

STAGES = [
    ("language_id", stages.language_stage),
    ("quality_rules", stages.quality_stage),
    ("simhash_near_dedup", stages.near_duplicate_stage),
    ("source_mixing", stages.mixing_stage),
    ("best_fit_packing", stages.packing_stage),
]

#: SQL cannot express the learned stages; tests hold each stage against a plain version of its decision, and its rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over all documents of sf_dir."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
