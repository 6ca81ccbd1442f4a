"""Column expressions over text: headings, prose tests, markup, sentences, tokens.

Patterns carry (?U) where Unicode white space, letters and word boundaries are meant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and patterns of the article grammar.
HEADING_CHARS, HEADING_WORDS = 90, 10
REFERENCE_CHARS, REFERENCE_SHARE = 60, 0.6
TABLE_TABS, QUERY_TAGS, CHECKBOXES = 2, 2, 4
PROSE_MIN_WORDS, MIN_STOPWORD_SHARE = 25, 0.08
ABSTRACT_CHARS, HEAD_CHARS, HEAD_MIN = 2500, 2000, 100
NUMBERING = r"^\s*(\d+(\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.)\s+"
SUBSECTION = r"^\s*\d+(\.\d+)+\.?\s+\S"
BOILERPLATE_STARTS = (
    "references?|bibliography|literature cited|acknowledge?ments?|funding|financial support|grant support"
    "|conflicts? of interest|competing interests?|declarations?|disclosures?"
    "|data availability|availability of data|code availability"
    "|authors?.? (contributions?|information|notes?)|contributor information"
    "|ethics?|ethical|consent|informed consent|human and animal rights"
    "|orcid|publisher.?s note|provenance and peer review|copyright|permissions"
    "|footnotes?|abbreviations|trial registration|clinical trial number|registration|peer review"
)
BOILERPLATE_WHOLE = "supplement(ary|al)( material| information| data| files?)?|supporting information|online only material|figures?|tables?|appendix|glossary"
APPENDIX = r"\*{3,}$|DOI: 10\.\S+\.p?r\d+|decision letter|author response|acceptance letter|referee report|reviewer response|peer review history|reviewer #\s*\d|submission version"
SECTIONS = {
    "abstract": "abstract|summary",
    "introduction": "introduction|background|objectives?|aims?|purpose|rationale",
    "methods": "(materials? and )?methods?|methodology|study design|design|participants|subjects|measures|instruments|procedures?|statistical analys[ei]s|data (collection|analysis)|sample",
    "results": "results?|findings|outcomes",
    "discussion": "discussion|interpretation|limitations?|strengths?",
    "conclusion": "conclusions?|implications?|recommendations?",
}
FIELD_TAG = r"\[\s*(title/abstract|mesh terms?|tiab|all fields)\s*\]"
CHECKBOX = r"[(\[]\s*[)\]]"
LATEX = r"\\documentclass.*?\\end\{document\}"
REFERENCE_NUMBER = r"^\s*\d{1,3}[.)]?\s+"
YEAR = r"\b(19|20)\d{2}\b"
RULE = "\x9f=+\x9f"
STOPWORDS = (
    "the of and in to a was were is are for with that this we our by on as at from be"
    " been between than not it its these those their has have had"
).split()
WORD_EDGES = ".,;:()[]\"'“”"


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def words(col: Column) -> Column:
    return F.filter(F.split(squeeze(col), " "), lambda w: w != "")


def strip_numbering(heading: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(heading), f"(?U){NUMBERING}", ""), ":+$", ""))


def is_subsection(heading: Column) -> Column:
    return heading.rlike(f"(?U){SUBSECTION}")


def is_heading(block: Column) -> Column:
    t = F.trim(F.regexp_replace(block, r"(?U)^\s+|\s+$", ""))
    return (t != "") & ~t.contains("\n") & ~block.contains("\t") & (F.length(t) <= HEADING_CHARS) & (F.size(words(t)) <= HEADING_WORDS) & ~t.rlike("[.;,]$")


def canonical_section(heading: Column) -> Column:
    plain = strip_numbering(heading)
    out = None
    for name, pattern in SECTIONS.items():
        test = plain.rlike(f"(?iu)^({pattern})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def is_boilerplate(heading: Column) -> Column:
    plain = strip_numbering(heading)
    return plain.rlike(f"(?iuU)^({BOILERPLATE_STARTS})\\b") | plain.rlike(f"(?iu)^({BOILERPLATE_WHOLE})$")


def is_reference_line(line: Column) -> Column:
    return (F.length(line) > REFERENCE_CHARS) & line.rlike(f"(?U){REFERENCE_NUMBER}") & line.rlike(f"(?U){YEAR}")


def strip_latex(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, f"(?s){LATEX}", " "))


def strip_search_strategy(text: Column) -> Column:
    tag = F.lit(f"(?iU){FIELD_TAG}")
    kept = F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_count(s, tag) < QUERY_TAGS)
    return F.when(F.regexp_count(text, tag) < QUERY_TAGS, text).otherwise(F.trim(F.array_join(kept, " ")))


def bare_words(text: Column) -> Column:
    """Lower-case words without the punctuation around them."""
    return F.filter(F.transform(words(text), lambda w: F.lower(F.btrim(w, F.lit(WORD_EDGES)))), lambda w: w != "")


def stopword_share(text: Column) -> Column:
    w = bare_words(text)
    return F.coalesce(F.try_divide(F.size(F.filter(w, lambda x: x.isin(STOPWORDS))).cast("double"), F.size(w)), F.lit(0.0))


def is_prose(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(f"(?U){CHECKBOX}")) < CHECKBOXES) & ((F.size(words(text)) < PROSE_MIN_WORDS) | (stopword_share(text) >= MIN_STOPWORD_SHARE))


def article_body(raw: Column) -> Column:
    """What follows the first rule; all of it where there is none."""
    return F.regexp_replace(raw, f"(?s)^.*?{RULE}", "")


def head_abstract(raw: Column) -> Column:
    """The first characters after the rule, null where they are too few."""
    head = squeeze(F.substring(article_body(raw), 1, HEAD_CHARS))
    return F.when(raw.rlike(RULE) & (F.length(head) >= HEAD_MIN), head)


def plain(markup: Column) -> Column:
    """Text of HTML: the end of a heading becomes a colon, other tags a space."""
    return squeeze(F.regexp_replace(F.regexp_replace(markup, r"</h\d>", ": "), r"<[^>]+>", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+(?=[\"(\[]?[A-Z0-9])"), lambda s: F.trim(s) != "")


def tokens(text: Column, least: int = 1) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least)


def match_terms(query: Column) -> Column:
    """Query terms of three characters or more, repeats kept."""
    return tokens(query, 3)


def match_expression(query: Column) -> Column:
    return F.array_join(F.transform(match_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def finding_id(work_id: Column, claim: Column) -> Column:
    return F.concat(F.lit("f_"), F.substring(F.sha2(F.concat_ws("\n", work_id, F.lower(squeeze(claim))).cast("binary"), 256), 1, 16))


def strip_fences(text: Column) -> Column:
    t = F.trim(text)
    inner = F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise("")
    return F.when(t.startswith("```"), F.trim(F.regexp_replace(inner, r"(?s)```(?!.*```).*$", ""))).otherwise(t)


def jats_text(xml: Column) -> Column:
    """Text nodes below the body (below the root where there is no body), stripped and joined; null if there are none."""
    nodes = lambda p: F.filter(F.transform(F.xpath(xml, F.lit(p)), lambda x: squeeze(x)), lambda x: x != "")
    body = nodes("//body//text()")
    return F.nullif(F.array_join(F.when(F.size(F.xpath(xml, F.lit("//body"))) > 0, body).otherwise(nodes("//text()")), " "), F.lit(""))
