"""Readers of the file formats in use: JSON lines, judgments, query lists, topic lists, whole texts, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as T

PAPER = "work_id string, title string, year int, doi string, pmcid string, abstract string, stratum string"
VERDICT = "work_id string, relevance int, domain string, study_type string, confidence double"
HEAD_CHARS = 40_000
TOPIC = r"^-\s+(.+?)(?:\s+\((T\d+)\))?\s*$"


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Plain or zstd-compressed JSON lines; blank lines don't make rows."""
    cols = spark.createDataFrame([], schema).columns
    return spark.read.schema(schema).json(path).filter(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull())


def write_jsonl(df: DataFrame, path: str) -> int:
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.schema(df.schema).json(path).count()


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0), line: the lines of one small text file in their order."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return whole


def queries(spark: SparkSession, path: str) -> DataFrame:
    """qid (from 1), query: lines that aren't blank and don't begin with #."""
    kept = numbered(spark, path).withColumn("query", F.trim("line")).filter((F.col("query") != "") & ~F.col("query").startswith("#"))
    return kept.withColumn("qid", F.row_number().over(Window.orderBy("n"))).select("qid", "query")  # a hand-written list


def judgments(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """qid, doc, relevant from tab-separated lines under a header; the last line of a pair counts. strict skips other verdicts than 0 and 1."""
    cell = F.split("line", "\t")
    rows = numbered(spark, path).filter("n > 0").filter(F.size(cell) >= 3).select("n", F.expr("try_cast(split(line, '\\t')[0] AS int)").alias("qid"), F.get(cell, 1).alias("doc"), F.trim(F.get(cell, 2)).alias("v"))
    rows = rows.filter("qid is not null")
    rows = rows.filter(F.col("v").isin("0", "1")) if strict else rows.filter(F.col("v").rlike(r"^\d+$"))
    return rows.groupBy("qid", "doc").agg(F.max_by(F.col("v").cast("int"), "n").alias("relevant"))


def topics(lines: DataFrame, column: str = "line") -> DataFrame:
    """name, openalex_id, query of bullet lines `- Name (T123) :: query`; other lines are ignored."""
    head = F.trim(F.when(F.contains(F.col(column), F.lit("::")), F.regexp_extract(column, r"^(.*?)::", 1)).otherwise(F.col(column)))
    query = F.nullif(F.trim(F.when(F.contains(F.col(column), F.lit("::")), F.regexp_extract(column, r"::(.*)$", 1))), F.lit(""))
    hit = head.rlike(TOPIC)
    return lines.filter(hit).select(F.regexp_extract(head, TOPIC, 1).alias("name"), F.nullif(F.regexp_extract(head, TOPIC, 2), F.lit("")).alias("openalex_id"), query.alias("query"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row for each file of a folder, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def heads(works: DataFrame, files: DataFrame) -> DataFrame:
    """work_id, head: the first characters of each work's file, by its base name; null where there is none."""
    base = F.substring_index("text_path", "/", -1)
    return works.select("work_id", base.alias("file")).join(files, "file", "left").select("work_id", F.substring("text", 1, HEAD_CHARS).alias("head"))


def file_name(work_id):
    """The name of a work's flat file."""
    return F.concat(F.regexp_replace(work_id, "/", "_"), F.lit(".txt"))


def object_keys(listing: DataFrame, suffix: str, column: str = "xml") -> DataFrame:
    """The first key with a suffix in each bucket listing, whatever its namespace."""
    plain = F.regexp_replace(column, r'\sxmlns="[^"]*"', "")
    return listing.withColumn("key", F.get(F.filter(F.xpath(plain, F.lit("//Key/text()")), lambda k: F.endswith(k, F.lit(suffix))), 0))


def article_xml(raw: DataFrame, column: str = "xml") -> DataFrame:
    return raw.withColumn("text", T.jats_text(F.col(column)))


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files; a missing file is an error of the reader."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
