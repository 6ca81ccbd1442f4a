"""From raw documents to shards: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes all documents that its predecessor kept and returns documents with their own
columns (the last one returns the shard of each). Between stages the documents are written as
Parquet in the shared folder and read again, so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import common, decontamination, mixing, near_dedup, quality_rules, sharding

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

# Not expressible in SQL: the forest, the signatures and the ring are tested by brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(common.tables(sf_dir, "documents"))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stash(docs)
    return docs
