"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; results are written to the shared folder and read again, so a lost
executor costs at most one stage."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortwave.llm.common import read
from cohortwave.llm.decontaminate import decontaminate_stage
from cohortwave.llm.jaccard import jaccard_stage
from cohortwave.llm.packing import packing_stage
from cohortwave.llm.pii import pii_stage
from cohortwave.llm.quality import quality_stage
from cohortwave.session import cut_lineage

STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", jaccard_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the outlier estimate nor the packing; tests/llm/test_pipeline.py checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
