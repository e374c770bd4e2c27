"""From raw documents to packed sequences: five stages, each one of the operators in jambwork.llm.

Each stage takes (spark, docs, sf_dir); its rows are written and read again as
the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jambwork.llm import jaccard, mixing, packing, suffixes, toxicity
from jambwork.llm.common import stored, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("suffix-array dedup", suffixes.stage),
    ("mixing sources to target weights", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can't express the models and the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
