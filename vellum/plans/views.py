"""Relations in the shape of a literature corpus, derived from the driver's tables with whole-number rules.

Every view has a DuckDB twin in vellum.plans.duck, written from the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import records as R
from vellum.functions import text as T
from vellum.operators import lexical

TYPES = list(R.GRADES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def works(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), (i % 11).cast("int"))
    stype = F.when(i % 5 != 0, kind)
    names = F.when(i % 4 == 1, "Ann Lee; Bo Chen").when(i % 4 == 2, '["Ann Lee"," Bo Chen ",""]').when(i % 4 == 3, "Ann Lee, Bo Chen.")
    j = d.join(table(spark, sf, "labels"), "doc_id", "left")
    return j.select(
        "doc_id",
        F.concat(F.lit("W"), i).alias("work_id"),
        F.substring("text", 1, 60).alias("title"),
        F.when(i % 17 != 0, (1990 + i % 36).cast("int")).alias("year"),
        F.when(i % 6 != 0, F.concat(F.lit("10.1000/AbC"), i)).alias("doi"),
        F.when(i % 4 != 0, F.concat(F.lit("PMC"), i)).alias("pmcid"),
        F.when(i % 3 == 0, "openalex").when(i % 3 == 1, "europepmc").otherwise("citation").alias("discovered_via"),
        F.when(i % 10 < 6, "kept_text").when(i % 10 < 8, "kept_miss").when(i % 10 == 8, "rejected").otherwise("retracted").alias("status"),
        stype.alias("study_type"),
        F.when(i % 8 == 0, R.grade(stype)).alias("evidence_grade"),
        (F.col("quality") * 6 + i % 5).cast("int").alias("relevance"),
        F.when(F.col("quality").isNull(), (i % 100).cast("double") / F.lit(100.0)).alias("gate_p5"),
        names.alias("authors"),
        F.when(i % 10 < 6, F.concat(F.lit("/texts/W"), i, F.lit(".txt"))).alias("text_path"),
        F.when(i % 9 == 0, F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")).alias("chunked_at"),
        F.when(i % 12 == 0, F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")).alias("extracted_at"),
        F.when(i % 13 < 6, F.lit("2024-02-01").cast("timestamp_ntz") + F.make_dt_interval((i % 13).cast("int"))).alias("retraction_checked_at"),
        F.when(i % 7 == 0, "openalex").alias("venue_source"),
        F.when(i % 14 == 0, "openalex").alias("authors_source"),
        F.get(F.array(*[F.lit(x) for x in R.DOMAINS]), (i % 7).cast("int")).alias("domain"),
    )


def graded(w: DataFrame) -> DataFrame:
    """works with grades filled in and quality composed."""
    w = w.withColumn("evidence_grade", F.coalesce("evidence_grade", R.grade(F.col("study_type"))))
    return w.withColumn("quality", R.quality(F.col("relevance"), F.col("gate_p5"), F.col("evidence_grade"))).withColumn("quality_source", R.quality_source(F.col("relevance"), F.col("gate_p5")))


def abstracts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("doc_id % 7 <> 0")
    return d.select(F.concat(F.lit("W"), "doc_id").alias("work_id"), F.when(F.col("doc_id") % 19 != 0, F.substring("text", 1, 2000)).alias("abstract"), F.lit("text").alias("source"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """work_id, idx, text: the lines of every document, its passages here."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return d.select("doc_id", F.concat(F.lit("W"), "doc_id").alias("work_id"), F.concat(F.lit("W"), "doc_id", F.lit("#"), "idx").alias("chunk_id"), "idx", "text", F.when(F.col("idx") % 2 == 0, "methods").otherwise("results").alias("section"))


def findings(spark: SparkSession, sf: str) -> DataFrame:
    c = lines(spark, sf).filter("length(text) between 20 and 300 and idx % 3 = 0 and doc_id % 10 < 6")
    return c.select(T.finding_id(F.col("work_id"), F.col("text")).alias("finding_id"), "work_id", F.col("text").alias("claim"), F.lit("small sample").alias("caveats"), F.col("chunk_id").alias("anchor_chunk_id"), F.lit(0).alias("char_start"), F.lit(10).alias("char_end"), F.substring("text", 1, 10).alias("quote")).dropDuplicates(["finding_id"])


def verdicts(spark: SparkSession, sf: str, other: bool = False) -> DataFrame:
    i = F.col("doc_id")
    base = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("W"), i).alias("work_id"), F.col("quality"))
    shift = (i % 4) if other else F.lit(0)
    dom = (i + (F.when(i % 6 == 0, 1).otherwise(0) if other else F.lit(0))) % 7
    typ = (i + (F.when(i % 10 == 0, 1).otherwise(0) if other else F.lit(0))) % 11
    base = base.filter(i % 9 != 0) if other else base
    return base.select("work_id", (F.col("quality") * 6 + i % 3 + shift).cast("int").alias("relevance"), F.get(F.array(*[F.lit(x) for x in R.DOMAINS]), dom.cast("int")).alias("domain"), F.get(F.array(*[F.lit(x) for x in TYPES]), typ.cast("int")).alias("study_type"), F.lit(0.5).alias("confidence"))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    g = e.groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n"))
    status = F.when(F.col("kind") == "signup", "pending").when(F.col("kind") == "error", "active").otherwise("done")
    return g.select(
        F.col("user_id").alias("id"),
        status.alias("status"),
        F.when(F.col("n") % 3 != 0, F.col("last")).alias("last_crawled_at"),
        F.when(F.col("n") % 2 == 0, F.to_date("last")).alias("watermark"),
        F.when(F.col("n") % 5 == 0, F.lit("c1")).alias("openalex_cursor"),
        F.lit(None).cast("string").alias("epmc_cursor"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, truth, prob, pred of a stand-in classifier on the labels."""
    i = F.col("doc_id")
    prob = ((F.col("quality") * 30 + i * 7 % 71) / F.lit(100.0)).cast("double")
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth"), prob.alias("prob"), F.when(prob >= 0.5, 1).otherwise(0).alias("pred"), "toxic")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select((F.col("item_id") + 1).alias("qid"), F.col("text").alias("query"))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """(qid, doc, relevant): a document is relevant if it holds the query's first 60 characters."""
    heads = queries(spark, sf).select("qid", F.substring("query", 1, 60).alias("phrase"))
    hit = lexical.holding(table(spark, sf, "documents"), heads, "doc_id", "text")
    return hit.select("qid", F.col("doc_id").alias("doc"), F.lit(1).alias("relevant")).distinct()
