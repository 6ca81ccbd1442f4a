"""Column expressions over bibliographic records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence grade of each study type, best first.
GRADES = {
    "meta_analysis": 1,
    "systematic_review": 1,
    "rct": 2,
    "cohort": 3,
    "case_control": 3,
    "cross_sectional": 4,
    "observational": 4,
    "case_report": 5,
    "opinion": 5,
    "qualitative": 5,
    "other": 5,
}

# Study type of each publication type that states one.
PUBLICATION_TYPES = {
    "meta-analysis": "meta_analysis",
    "network meta-analysis": "meta_analysis",
    "systematic review": "systematic_review",
    "systematic-review": "systematic_review",
    "randomized controlled trial": "rct",
    "randomized-controlled-trial": "rct",
    "observational study": "observational",
    "case reports": "case_report",
    "editorial": "opinion",
}

# Topical domains.
DOMAINS = ("mental-health", "sleep", "stress", "pain", "lifestyle", "other-medical", "off-topic")

GATE_PRECISION, GRADE_STEP = 0.69, 0.06


def lookup(table: dict[str, object], key: Column) -> Column:
    """table[key], null where it has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def filled(col: Column) -> Column:
    """Empty strings count as missing."""
    return F.nullif(col, F.lit(""))


def short_id(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def short_doi(col: Column) -> Column:
    return F.regexp_replace(col, r"^https://doi\.org/", "")


def norm_doi(col: Column) -> Column:
    return short_doi(F.lower(col))


def canonical_id(openalex: Column, doi: Column, pmcid: Column) -> Column:
    """First identifier there is, with its scheme; null where there is none (see require_id)."""
    return F.coalesce(filled(openalex), F.concat(F.lit("doi:"), filled(doi)), F.concat(F.lit("pmcid:"), filled(pmcid)))


def require_id(identifier: Column) -> Column:
    """identifier, or an error where a record has none."""
    return F.coalesce(identifier, F.raise_error(F.lit("a record needs an OpenAlex id, a DOI or a PMCID")).cast("string"))


def year_bucket(year: Column) -> Column:
    return F.when(year.isNull(), "unknown").when(year < 2000, "pre2000").when(year < 2010, "2000s").when(year < 2020, "2010s").otherwise("2020s")


def stratum(via: Column, status: Column, year: Column) -> Column:
    return F.concat_ws("/", via, status, year_bucket(year))


def grade(study_type: Column) -> Column:
    return lookup(GRADES, study_type)


def study_type(pub_types: Column) -> Column:
    """The best-graded study type among publication types; the first of equals."""
    named = F.filter(F.transform(pub_types, lambda x, i: F.struct(lookup(GRADES, lookup(PUBLICATION_TYPES, F.lower(x))).alias("g"), i.alias("i"), lookup(PUBLICATION_TYPES, F.lower(x)).alias("t"))), lambda s: s["t"].isNotNull())
    return F.array_min(named)["t"]


def quality(relevance: Column, gate: Column, evidence: Column) -> Column:
    """0..1 from a judged relevance, else the gate's probability; lower for weaker evidence; null without either."""
    base = F.coalesce(relevance.cast("double") / F.lit(10.0), gate * F.lit(GATE_PRECISION))
    worth = base * (F.lit(1.0) - F.lit(GRADE_STEP) * (F.coalesce(evidence, F.lit(1)) - 1))
    return F.when(base.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), worth)), 4))


def quality_source(relevance: Column, gate: Column, judged: str = "judge", gated: str = "gate") -> Column:
    return F.when(relevance.isNotNull(), judged).when(gate.isNotNull(), gated)


def authors(raw: Column) -> Column:
    """Names from a JSON array, a semicolon list or a comma list."""
    listed = F.when(F.trim(raw).startswith("["), F.from_json(raw, "array<string>")).when(F.contains(raw, F.lit(";")), F.split(raw, ";")).otherwise(F.split(raw, ","))
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""))


def looked_up_authors(structured: Column, author_string: Column) -> Column:
    """Structured names if any, else the comma list without its final full stop."""
    listed = F.filter(F.transform(F.split(F.regexp_replace(F.trim(F.coalesce(author_string, F.lit(""))), r"\.$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    own = F.filter(F.transform(F.coalesce(structured, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(own) > 0, own).otherwise(listed)


def is_retracted(pub_types: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(pub_types, lambda x: F.lower(x)), "retracted publication"), F.lit(False))


def rebuilt_text(inverted: Column) -> Column:
    """Text from a map of words to their positions."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return filled(F.array_join(F.transform(F.array_sort(placed), lambda s: s["w"]), " "))


def is_client_error(status: Column) -> Column:
    """A request that was refused for what it says, not for its rate."""
    return status.between(400, 499) & (status != 429)


def is_quota_refusal(message: Column) -> Column:
    return message.rlike("(?i)spend limit|usage limit|rate limit")
