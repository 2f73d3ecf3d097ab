"""A corpus from documents: filter, deduplicate, decontaminate, mix and shard.

Every stage takes all that the one before it kept, written as Parquet and read again, so a lost executor costs a
part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from graphloom.llm.common import kept

STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("benchmark_decontamination", decontamination.stage),
    ("pareto_mixing", mixing.stage),
    ("label_propagation_sharding", sharding.stage),
]

#: The first two stages learn and cluster, the last iterates: no SQL; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
