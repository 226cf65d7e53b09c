"""Corpus preparation: language ID, quality selection, near-duplicate removal, sequence packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
stage's documents; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from telemetry_lake.llm.common import table, written
from telemetry_lake.llm.language import language_stage
from telemetry_lake.llm.near_duplicates import near_duplicate_stage
from telemetry_lake.llm.packing import packing_stage
from telemetry_lake.llm.quality import quality_stage

STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("minhash_near_duplicates", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]
#: Trained models and hashed signatures decide, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
