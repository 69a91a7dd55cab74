"""Cleaning pipeline over ``documents``: each stage reads what the one before it kept.

All stages but the last return the columns of ``documents``; the last returns one row for each packed piece. SQL can
express none of the classifiers, so ORACLE_SQL is None and the stages are tested against plain Python versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborq.llm import line_dedup, packing, quality, simhash, toxicity
from arborq.llm.common import Stage

STAGES = [
    ("quality", quality.quality_stage),
    ("toxicity", toxicity.toxicity_stage),
    ("line dedup", line_dedup.line_stage),
    ("near dedup", simhash.simhash_stage),
    ("packing", packing.packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage keeps is written to the shared folder and read again by the next.

    Null and empty texts are documents like any other, and pass or go as the classifiers say; further columns of any names are carried to the last stage; rows that share an
    identifier are kept or rejected together; an empty table gives no pieces.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = Stage(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shared.table(docs)
    return docs
