"""Remote records (JSON) to flat candidates. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import records as R
from vellum.functions import text as T

CANDIDATE = "work_id string, openalex_id string, doi string, pmcid string, title string, authors string, year int, license string, is_oa boolean, is_retracted boolean, abstract string, pub_types array<string>, discovered_via string"
OPENALEX = "id string, doi string, display_name string, publication_year int, is_retracted boolean, open_access struct<is_oa:boolean>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>"
EPMC = "pmcid string, doi string, title string, authorString string, pubYear string, license string, isOpenAccess string, abstractText string, pubTypeList struct<pubType:array<string>>, journalInfo struct<journal:struct<title:string>>"


def from_openalex(raw: DataFrame, column: str = "json", via: str = "openalex") -> DataFrame:
    r = raw.select(F.from_json(column, OPENALEX).alias("r")).select("r.*")
    oa, doi = R.filled(R.short_id(F.col("id"))), R.filled(R.short_doi(F.col("doi")))
    return r.select(
        R.canonical_id(oa, doi, F.lit(None).cast("string")).alias("work_id"),
        oa.alias("openalex_id"),
        doi.alias("doi"),
        F.lit(None).cast("string").alias("pmcid"),
        F.trim(F.coalesce("display_name", F.lit(""))).alias("title"),
        F.lit(None).cast("string").alias("authors"),
        F.col("publication_year").alias("year"),
        F.lit(None).cast("string").alias("license"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_oa"),
        F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
        R.rebuilt_text(F.col("abstract_inverted_index")).alias("abstract"),
        F.array().cast("array<string>").alias("pub_types"),
        F.lit(via).alias("discovered_via"),
    )


def from_epmc(raw: DataFrame, column: str = "json") -> DataFrame:
    """Records with neither a pmcid nor a doi are left out."""
    r = raw.select(F.from_json(column, EPMC).alias("r")).select("r.*")
    types = F.coalesce("pubTypeList.pubType", F.array().cast("array<string>"))
    doi, pmcid = R.filled(F.col("doi")), R.filled(F.col("pmcid"))
    return r.filter(doi.isNotNull() | pmcid.isNotNull()).select(
        R.canonical_id(F.lit(None).cast("string"), doi, pmcid).alias("work_id"),
        F.lit(None).cast("string").alias("openalex_id"),
        doi.alias("doi"),
        pmcid.alias("pmcid"),
        F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        R.filled(F.col("authorString")).alias("authors"),
        F.expr("try_cast(pubYear AS int)").alias("year"),
        R.filled(F.col("license")).alias("license"),
        F.coalesce(F.col("isOpenAccess") == "Y", F.lit(False)).alias("is_oa"),
        R.is_retracted(types).alias("is_retracted"),
        F.nullif(T.plain(F.coalesce("abstractText", F.lit(""))), F.lit("")).alias("abstract"),
        types.alias("pub_types"),
        F.lit("europepmc").alias("discovered_via"),
    )


def journals(raw: DataFrame, column: str = "json") -> DataFrame:
    """doi, pmcid and venue (the journal's title; blank ones are absent) of records."""
    r = raw.select(F.from_json(column, EPMC).alias("r")).select("r.*")
    return r.select(F.lower("doi").alias("doi"), F.upper("pmcid").alias("pmcid"), R.filled(F.trim("journalInfo.journal.title")).alias("venue"))


def lookup_table(raw: DataFrame, column: str = "json") -> DataFrame:
    """doi, pmcid, title, authors, pub_types, is_retracted of records, for joins by identifier."""
    return from_epmc(raw, column).select(F.lower("doi").alias("doi"), F.upper("pmcid").alias("pmcid"), "title", "abstract", "authors", "pub_types", "is_retracted")


def edges(raw: DataFrame, column: str = "json") -> DataFrame:
    """src, dst: citations that the records state."""
    r = raw.select(F.from_json(column, OPENALEX).alias("r"))
    return r.select(R.short_id(F.col("r.id")).alias("src"), F.posexplode("r.referenced_works").alias("pos", "d")).select("src", "pos", R.short_id(F.col("d")).alias("dst"))
