"""The ingest lifecycle: a topic queue, resumable sweeps, gating, and the sink that stores before it banks.

State is tables (topics, works), rewritten by pure functions. Cursors and the date watermark live in
the topics table and move only after the candidates are stored, so a stream's checkpoint is needed
for at-least-once delivery only: stores are upserts and repeat safely.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import records as R
from vellum.operators import joins, store

STATUSES = ["candidate", "rejected", "retracted", "kept_miss", "kept_text"]


def due(cutoff: Column) -> Column:
    """Pending, or done and stale, never finished, or with a cursor held."""
    held = F.col("openalex_cursor").isNotNull() | F.col("epmc_cursor").isNotNull()
    return (F.col("status") == "pending") | ((F.col("status") == "done") & F.coalesce((F.col("last_crawled_at") < cutoff), F.lit(False)) | (F.col("status") == "done") & (F.col("watermark").isNull() | held))


def claim_next_topic(topics: DataFrame, cutoff: Column) -> DataFrame:
    """The one topic to work on next: pending first, then the longest untouched."""
    return topics.filter(due(cutoff)).orderBy((F.col("status") == "pending").desc(), F.asc_nulls_first("last_crawled_at"), "id").limit(1)


def topic(topics: DataFrame, ident: int) -> DataFrame:
    """The topic of this id, if there is one."""
    return topics.filter(F.col("id") == ident)


def update_topic(topics: DataFrame, ident: int, **values: Column) -> DataFrame:
    mine = F.col("id") == ident
    return topics.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in values.items()})


def recover(topics: DataFrame) -> DataFrame:
    """Topics left active by a crash are pending again."""
    return topics.withColumn("status", F.when(F.col("status") == "active", "pending").otherwise(F.col("status")))


def sync_topics(topics: DataFrame, wanted: DataFrame) -> DataFrame:
    """New names are added; a changed query drops the cursors and the watermark of its topic."""
    q = wanted.select("name", F.coalesce("query", "name").alias("__q"))
    j = topics.join(q, "name", "left")
    moved = F.col("__q").isNotNull() & ~F.col("__q").eqNullSafe(F.col("query"))
    j = j.withColumns({c: F.when(moved, F.lit(None)).otherwise(F.col(c)) for c in ("openalex_cursor", "epmc_cursor", "watermark")}).withColumn("query", F.when(moved, F.col("__q")).otherwise(F.col("query"))).drop("__q")
    have = topics.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    fresh = wanted.join(topics.select("name"), "name", "left_anti")
    from pyspark.sql import Window

    fresh = fresh.crossJoin(have).select((F.col("m") + F.row_number().over(Window.orderBy("name"))).cast("int").alias("id"), "name", F.coalesce("query", "name").alias("query"), "openalex_id", F.lit("pending").alias("status"), F.lit("config").alias("added_by"))
    return j.unionByName(fresh, allowMissingColumns=True)


@dataclass(frozen=True)
class Sweep:
    """Where a topic stands in its two listings; a cursor of None means that the listing is at its end."""

    openalex_cursor: str | None = None
    epmc_cursor: str | None = None
    watermark: str | None = None
    status: str = "active"
    stored: int = 0


class Refused(OSError):
    """The service refused a request; status as in HTTP."""

    def __init__(self, status: int):
        super().__init__(str(status))
        self.status = status


def run_pass(at: Sweep, today: str, discover: Callable[[Sweep], tuple[list, tuple[str | None, str | None]]], process: Callable[[list], int], expand: Callable[[], None]) -> Sweep:
    """One pass over a topic.

    A refused listing (4xx but 429) drops the cursors, any other failure keeps them. Candidates that
    can't be stored leave the old cursors in place. New cursors count once they are stored, also if
    the expansion fails after that. The watermark moves when both listings are at their end. A failed
    pass is done too, so that the queue goes on.
    """
    try:
        found, (a, b) = discover(at)
    except OSError as e:
        status = getattr(e, "status", None)
        refused = status is not None and 400 <= status < 500 and status != 429
        return replace(at, status="done", **({"openalex_cursor": None, "epmc_cursor": None} if refused else {}))
    try:
        n = process(found)
    except OSError:
        return replace(at, status="done")
    banked = replace(at, openalex_cursor=a, epmc_cursor=b, stored=at.stored + n)
    try:
        expand()
    except OSError:
        return replace(banked, status="done")
    return replace(banked, status="done", watermark=at.watermark if a or b else today)


def gated(candidates: DataFrame) -> DataFrame:
    """Candidates with the status that their metadata gives them: retracted, rejected, or kept_miss until a text is found."""
    status = F.when(F.col("is_retracted"), "retracted").when(~F.col("is_oa"), "rejected").otherwise("kept_miss")
    graded = R.study_type(F.col("pub_types"))
    return candidates.withColumn("status", status).withColumn("reject_reason", F.when(F.col("status") == "rejected", "not_open_access")).withColumn("study_type", graded).withColumn("evidence_grade", R.grade(graded))


def fetched(works: DataFrame, bucket: DataFrame, xml: DataFrame) -> DataFrame:
    """Texts onto kept works: from the bucket, else from the XML service; kept_text where one was found."""
    b, x = bucket.select("pmcid", F.col("text").alias("__b")), xml.select("pmcid", F.col("text").alias("__x"))
    j = works.join(b, "pmcid", "left").join(x, "pmcid", "left")
    text = F.coalesce(R.filled(F.col("__b")), R.filled(F.col("__x")))
    source = F.when(R.filled(F.col("__b")).isNotNull(), "pmc_oa_txt").when(R.filled(F.col("__x")).isNotNull(), "epmc_fulltext_xml")
    hit = (F.col("status") == "kept_miss") & text.isNotNull()
    return j.withColumn("text", F.when(hit, text)).withColumn("text_source", F.when(hit, source)).withColumn("status", F.when(hit, "kept_text").otherwise(F.col("status"))).drop("__b", "__x")


def process(works: DataFrame, candidates: DataFrame, pmcids: DataFrame, bucket: DataFrame, xml: DataFrame, order: str = "seq") -> DataFrame:
    """works after a batch of candidates: deduplicated, unseen ones only, gated, given ids and texts, upserted."""
    unique = joins.candidates_deduped(candidates, order)
    known = joins.seen(unique, works, order).withColumnRenamed("tag", order)
    fresh = fetched(gated(joins.fill_pmcids(unique.join(known, order, "left_anti"), pmcids)), bucket, xml)
    cols = [c for c in works.columns if c in fresh.columns]
    return store.record_works(works, fresh.select(*cols))


def drain_deferred(works: DataFrame, deferred: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Deferred candidates that are known under another id by now (rejected as duplicates), and the others."""
    known = joins.seen(deferred, works, order).withColumnRenamed("tag", order)
    dup = deferred.join(known, order, "left_semi").withColumns({"status": F.lit("rejected"), "reject_reason": F.lit("duplicate")})
    return dup, deferred.join(known, order, "left_anti")


def expansion(works: DataFrame, edges: DataFrame, per_pass: int = 10, references: int = 10) -> DataFrame:
    """Ids one citation away from a few kept works that weren't expanded yet: all citers, the first references."""
    seeds = works.filter(F.col("status").startswith("kept") & F.col("expanded_at").isNull() & F.col("openalex_id").isNotNull()).orderBy("work_id").limit(per_pass).select(F.col("openalex_id").alias("seed"))
    out = edges.join(seeds, F.col("src") == F.col("seed")).filter(F.col("pos") < references).select(F.col("dst").alias("openalex_id"))
    into = edges.join(seeds, F.col("dst") == F.col("seed")).select(F.col("src").alias("openalex_id"))
    return out.union(into).distinct().join(works.select("openalex_id"), "openalex_id", "left_anti")


def pass_summary(works: DataFrame) -> DataFrame:
    """pos, status, n: the known statuses in their order, also those that are absent, then others by name."""
    spark = works.sparkSession
    order = spark.createDataFrame(list(enumerate(STATUSES)), "pos int, status string")
    j = F.broadcast(order).join(works.groupBy("status").agg(F.count("*").alias("n")), "status", "full_outer")
    return j.select(F.coalesce("pos", F.lit(len(STATUSES))).alias("pos"), "status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ingest(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run sink on micro-batches of a candidate stream; what is there now, or for ever."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
