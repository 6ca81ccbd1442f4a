"""Ranked lists: fusion, union, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(rankings: DataFrame, k: int, c: int = 60) -> DataFrame:
    """qid, doc, score, rank by reciprocal ranks. rankings: qid, arm, rank, doc; ties keep the first seen (arm, then rank)."""
    fused = rankings.groupBy("qid", "doc").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"), F.min(F.struct("arm", "rank")).alias("seen"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "seen")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "doc", "score", "rank")


def union(rankings: DataFrame) -> DataFrame:
    """qid, doc, pos: every document once, in the order in which the arms list it first."""
    first = rankings.groupBy("qid", "doc").agg(F.min(F.struct("arm", "rank")).alias("seen"))
    return first.select("qid", "doc", (F.row_number().over(Window.partitionBy("qid").orderBy("seen"))).alias("pos"))


def top_k(scored: DataFrame, k: int, order: str = "pos") -> DataFrame:
    """The k best scores of each query, ties in candidate order."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
