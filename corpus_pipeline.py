"""A corpus pipeline of five stages, each applying one operator of tagloom.llm to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import stages
from tagloom.llm.workspace import Workspace

STAGES = stages.STAGES

#: Best-fit packing, alignment and compression cannot be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``, each stage's rows written as Parquet and read again."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"{k}_{name}")
    return docs
