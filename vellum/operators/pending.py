"""What is left to do: the predicates that make every pass resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.sampling import draw

POOL = "status = 'kept_text' and relevance >= 7"


def _kept(works: DataFrame) -> DataFrame:
    return works.filter(F.col("status").startswith("kept"))


def _first(df: DataFrame, limit: int | None, *order) -> DataFrame:
    df = df.orderBy(*order) if order else df
    return df if limit is None else df.limit(limit)


def judge(works: DataFrame, via: list[str] | None = None, status: str | None = None, only: DataFrame | None = None, seed: int = 7, limit: int | None = None) -> DataFrame:
    """Kept works without a relevance, in an order fixed by the seed."""
    df = _kept(works).filter("relevance is null")
    df = df.filter(F.col("discovered_via").isin(via)) if via else df
    df = df.filter(F.col("status") == status) if status else df
    df = df.join(only.select("work_id"), "work_id", "left_semi") if only is not None else df
    return _first(df.select("work_id"), limit, draw(seed, "work_id"), "work_id")


def chunk(works: DataFrame, min_relevance: int, limit: int | None = None) -> DataFrame:
    df = works.filter(F.col("text_path").isNotNull() & F.col("chunked_at").isNull() & (F.col("relevance") >= min_relevance))
    return _first(df.select("work_id", "text_path", "relevance"), limit, F.desc("relevance"), "work_id")


def gate(works: DataFrame, abstracts: DataFrame, slab: int | None = None) -> DataFrame:
    df = _kept(works).filter("relevance is null and gate_p5 is null").join(abstracts.filter(F.length("abstract") > 50), "work_id")
    return _first(df.select("work_id", F.concat_ws("\n\n", "title", F.substring("abstract", 1, 4000)).alias("text")), slab, "work_id")


def extract(works: DataFrame, chunks: DataFrame, min_relevance: int = 7, only: DataFrame | None = None, by_quality: bool = True, seed: int = 7, limit: int | None = None) -> DataFrame:
    df = works.filter((F.col("relevance") >= min_relevance) & (F.col("status") == "kept_text") & F.col("extracted_at").isNull())
    df = df.join(chunks.select("work_id"), "work_id", "left_semi")
    df = df.join(only.select("work_id"), "work_id", "left_semi") if only is not None else df
    order = (F.desc_nulls_last("quality"), "work_id") if by_quality else (draw(seed, "work_id"), "work_id")
    return _first(df.select("work_id", "quality"), limit, *order)


def abstract_texts(works: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Kept works with a text but no abstract, or a null one."""
    a = abstracts.select("work_id", "abstract")
    return _kept(works).filter("text_path is not null").join(a, "work_id", "left").filter("abstract is null").select("work_id", "text_path").orderBy("work_id")


def abstract_papers(works: DataFrame, abstracts: DataFrame, require_ids: bool) -> DataFrame:
    """Kept works without an abstract row."""
    df = _kept(works).join(abstracts.select("work_id"), "work_id", "left_anti")
    df = df.filter(F.col("doi").isNotNull() | F.col("pmcid").isNotNull()) if require_ids else df
    return df.select("work_id", "doi", "pmcid").orderBy("work_id")


def mark_missing(works: DataFrame, abstracts: DataFrame) -> DataFrame:
    """abstracts with an explicit row for every kept work that has none."""
    missing = abstract_papers(works, abstracts, False).select("work_id", F.lit(None).cast("string").alias("abstract"), F.lit("missing").alias("source"))
    return abstracts.select("work_id", "abstract", "source").unionByName(missing)


def venue(works: DataFrame) -> DataFrame:
    return works.filter(POOL).filter("venue_source is null").select("work_id", "doi", "pmcid").orderBy("work_id")


def authors(works: DataFrame) -> DataFrame:
    blank = F.coalesce(F.trim("authors"), F.lit("")).isin("", "[]")
    return works.filter(POOL).filter(blank & F.col("authors_source").isNull()).select("work_id", "doi", "pmcid").orderBy("work_id")


def retraction(works: DataFrame, stale_before=None) -> DataFrame:
    """Pool works never checked, or checked before a time."""
    due = F.col("retraction_checked_at").isNull()
    due = due | (F.col("retraction_checked_at") < stale_before) if stale_before is not None else due
    return works.filter(POOL).filter(due).select("work_id", "doi").orderBy("work_id")
