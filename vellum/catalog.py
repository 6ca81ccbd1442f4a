"""Queries for the driver, by name, and their DuckDB counterparts.

Every query runs over its whole tables. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from vellum.functions import records as R
from vellum.functions import text as T
from vellum.operators import clean, distill, extract, joins, lexical, metrics, pending, publish, rank, sampling, service, store, vector
from vellum.plans import duck as D
from vellum.plans import views as V
from vellum.sources import records
from vellum.streaming import events, lifecycle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- projections over records ------------------------------------------------------------------

GRADED = D.ctes(D.WORKS, D.GRADED)


@query("quality_compose", GRADED + "SELECT work_id, quality, quality_source FROM graded WHERE quality IS NOT NULL")
def quality_compose(spark, sf):
    return V.graded(V.works(spark, sf)).filter("quality is not null").select("work_id", "quality", "quality_source")


@query("grade_backfill", GRADED + "SELECT g.work_id, g.evidence_grade, w.evidence_grade IS NULL AND g.evidence_grade IS NOT NULL AS filled FROM graded g JOIN works w USING (work_id)")
def grade_backfill(spark, sf):
    w = V.works(spark, sf)
    new = F.coalesce("evidence_grade", R.grade(F.col("study_type")))
    return w.select("work_id", new.alias("evidence_grade"), (F.col("evidence_grade").isNull() & new.isNotNull()).alias("filled"))


@query("quality_totals", GRADED + "SELECT quality_source, count(*) AS n, round(avg(quality), 6) AS mean, min(quality) AS least, max(quality) AS most FROM graded WHERE quality IS NOT NULL GROUP BY 1")
def quality_totals(spark, sf):
    g = V.graded(V.works(spark, sf)).filter("quality is not null")
    return g.groupBy("quality_source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean"), F.min("quality").alias("least"), F.max("quality").alias("most")).orderBy(F.desc("n"))


@query("shippable_summary", D.ctes(D.WORKS, D.GRADED, D.LINES, D.FINDINGS) + "SELECT count(*) AS n, round(avg(quality), 6) AS mean, min(quality) AS least, max(quality) AS most FROM graded w WHERE quality IS NOT NULL AND EXISTS (SELECT 1 FROM findings f WHERE f.work_id = w.work_id)")
def shippable_summary(spark, sf):
    g = V.graded(V.works(spark, sf)).filter("quality is not null").join(V.findings(spark, sf), "work_id", "left_semi")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean"), F.min("quality").alias("least"), F.max("quality").alias("most"))


@query("canonical_id", D.ctes(D.WORKS) + "SELECT work_id, CASE WHEN doc_id % 5 = 0 THEN 'W' || doc_id WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN pmcid IS NOT NULL THEN 'pmcid:' || pmcid END AS canonical, lower(doi) AS norm, doi AS short FROM works")
def canonical_id(spark, sf):
    w = V.works(spark, sf).withColumn("url", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("https://example.org/"), "work_id")).otherwise(""))
    full = F.concat(F.lit("https://doi.org/"), "doi")
    return w.select("work_id", R.canonical_id(R.short_id(F.col("url")), F.col("doi"), F.col("pmcid")).alias("canonical"), R.norm_doi(full).alias("norm"), R.short_doi(full).alias("short"))


BUCKET = "CASE WHEN year IS NULL THEN 'unknown' WHEN year < 2000 THEN 'pre2000' WHEN year < 2010 THEN '2000s' WHEN year < 2020 THEN '2010s' ELSE '2020s' END"


@query("stratum_counts", D.ctes(D.WORKS) + f"SELECT discovered_via || '/' || status || '/' || {BUCKET} AS stratum, count(*) AS n, min(work_id) AS first FROM works WHERE status LIKE 'kept%' GROUP BY 1")
def stratum_counts(spark, sf):
    w = V.works(spark, sf).filter(F.col("status").startswith("kept"))
    return w.groupBy(R.stratum(F.col("discovered_via"), F.col("status"), F.col("year")).alias("stratum")).agg(F.count("*").alias("n"), F.min("work_id").alias("first"))


STRATA = D.ctes(D.WORKS, f"kept AS (SELECT work_id, discovered_via || '/' || status || '/' || {BUCKET} AS stratum FROM works WHERE status LIKE 'kept%')")
ALLOCATED = """, base AS (SELECT stratum, count(*) AS size, least(count(*), 5) AS base FROM kept GROUP BY 1),
room AS (SELECT *, size - base AS room, sum(size - base) OVER () AS pool, least(greatest(200 - sum(base) OVER (), 0), sum(size - base) OVER ()) AS rest FROM base),
share AS (SELECT *, CASE WHEN pool > 0 THEN rest * room // pool ELSE 0 END AS whole FROM room),
alloc AS (SELECT stratum, base + whole + (row_number() OVER (ORDER BY rest * room - whole * pool DESC, room DESC, stratum) <= rest - sum(whole) OVER ())::INT AS take FROM share),
picked AS (SELECT work_id, stratum FROM (SELECT k.*, take, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || work_id), work_id) AS r FROM kept k JOIN alloc USING (stratum)) WHERE r <= take)
"""


@query("stratified_sample", STRATA + ALLOCATED + "SELECT *, CAST(row_number() OVER (ORDER BY md5('8:' || work_id), work_id) AS INT) AS pos FROM picked")
def stratified_sample(spark, sf):
    w = V.works(spark, sf).filter(F.col("status").startswith("kept"))
    w = w.withColumn("stratum", R.stratum(F.col("discovered_via"), F.col("status"), F.col("year")))
    return sampling.stratified(w.select("work_id", "stratum"), "stratum", "work_id", 200, 5)


@query("stratified_split", "SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('7:' || doc_id), doc_id) <= round_even(count(*) OVER (PARTITION BY toxic) * 0.2, 0) AS is_test FROM labels")
def stratified_split(spark, sf):
    return sampling.split(V.table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query("study_type_from_pub_types", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'meta_analysis' WHEN 1 THEN 'rct' WHEN 2 THEN 'case_report' END AS study_type FROM documents")
def study_type_from_pub_types(spark, sf):
    i = F.col("doc_id") % 4
    types = F.when(i == 0, F.array(F.lit("Editorial"), F.lit("Network Meta-Analysis"))).when(i == 1, F.array(F.lit("Case Reports"), F.lit("Randomized Controlled Trial"))).when(i == 2, F.array(F.lit("Journal Article"), F.lit("case reports"), F.lit("editorial"))).otherwise(F.array(F.lit("Journal Article")))
    return V.table(spark, sf, "documents").select("doc_id", R.study_type(types).alias("study_type"))


@query("authors_array", D.ctes(D.WORKS) + "SELECT work_id, CASE doc_id % 4 WHEN 1 THEN 'Ann Lee|Bo Chen' WHEN 2 THEN 'Ann Lee|Bo Chen' WHEN 3 THEN 'Ann Lee|Bo Chen.' ELSE '' END AS names, CASE WHEN doc_id % 4 = 3 THEN 'Ann Lee|Bo Chen' END AS looked_up FROM works")
def authors_array(spark, sf):
    w = V.works(spark, sf)
    looked = F.when(F.col("doc_id") % 4 == 3, F.array_join(R.looked_up_authors(F.lit(None).cast("array<string>"), F.col("authors")), "|"))
    return w.select("work_id", F.array_join(R.authors(F.col("authors")), "|").alias("names"), looked.alias("looked_up"))


WORDS5 = "list_slice(string_split(text, ' '), 1, 5)"


@query("rebuild_abstract", f"SELECT doc_id, array_to_string(list_filter({WORDS5}, lambda x: x <> ''), ' ') AS rebuilt FROM documents")
def rebuild_abstract(spark, sf):
    d = V.table(spark, sf, "documents").withColumn("w", F.filter(F.slice(F.split("text", " "), 1, 5), lambda x: x != ""))
    keys = F.array_distinct("w")
    inverted = F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(F.transform("w", lambda x, i: F.when(x == k, i)), lambda p: p.isNotNull())))
    return d.select("doc_id", F.coalesce(R.rebuilt_text(inverted), F.lit("")).alias("rebuilt"))


@query("rebuild_abstract_whole", "SELECT doc_id, coalesce(array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' '), '') AS rebuilt FROM documents")
def rebuild_abstract_whole(spark, sf):
    d = V.table(spark, sf, "documents").withColumn("uid", F.monotonically_increasing_id())
    words = d.select("uid", "doc_id", F.posexplode_outer(F.filter(F.split("text", " "), lambda x: x != "")).alias("p", "w"))
    entries = words.groupBy("uid", "doc_id", "w").agg(F.collect_list("p").alias("at"))
    inverted = entries.groupBy("uid", "doc_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("w", "at")))).alias("inverted"))
    return inverted.select("doc_id", F.coalesce(R.rebuilt_text(F.col("inverted")), F.lit("")).alias("rebuilt"))


# --- pending sets ---------------------------------------------------------------------------

WA = D.ctes(D.WORKS, D.ABSTRACTS)


@query("pending_judge", D.ctes(D.WORKS) + "SELECT work_id FROM works WHERE status LIKE 'kept%' AND relevance IS NULL AND discovered_via IN ('openalex', 'citation')")
def pending_judge(spark, sf):
    return pending.judge(V.works(spark, sf), via=["openalex", "citation"])


@query("pending_chunk", D.ctes(D.WORKS) + "SELECT work_id, text_path, relevance FROM works WHERE text_path IS NOT NULL AND chunked_at IS NULL AND relevance >= 5")
def pending_chunk(spark, sf):
    return pending.chunk(V.works(spark, sf), 5)


@query("pending_gate", WA + "SELECT w.work_id, title || chr(10) || chr(10) || substr(abstract, 1, 4000) AS text FROM (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN gate_p5 END AS gate_p5) FROM works) w JOIN abstracts a ON w.work_id = a.work_id WHERE status LIKE 'kept%' AND relevance IS NULL AND gate_p5 IS NULL AND length(abstract) > 50")
def pending_gate(spark, sf):
    w = V.works(spark, sf).withColumn("gate_p5", F.when(F.col("doc_id") % 2 == 0, F.col("gate_p5")))
    return pending.gate(w, V.abstracts(spark, sf))


@query("pending_extract", D.ctes(D.WORKS, D.GRADED, D.LINES) + "SELECT work_id, quality FROM graded w WHERE relevance >= 7 AND status = 'kept_text' AND extracted_at IS NULL AND EXISTS (SELECT 1 FROM lines l WHERE l.work_id = w.work_id)")
def pending_extract(spark, sf):
    return pending.extract(V.graded(V.works(spark, sf)), V.lines(spark, sf))


@query("pending_abstract", WA + "SELECT w.work_id, w.text_path FROM works w LEFT JOIN abstracts a ON w.work_id = a.work_id WHERE status LIKE 'kept%' AND text_path IS NOT NULL AND abstract IS NULL")
def pending_abstract(spark, sf):
    return pending.abstract_texts(V.works(spark, sf), V.abstracts(spark, sf))


@query("pending_abstract_papers", WA + "SELECT work_id, doi, pmcid FROM works w WHERE status LIKE 'kept%' AND (doi IS NOT NULL OR pmcid IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM abstracts a WHERE a.work_id = w.work_id)")
def pending_abstract_papers(spark, sf):
    return pending.abstract_papers(V.works(spark, sf), V.abstracts(spark, sf), True)


@query("mark_missing", WA + "SELECT work_id, abstract, source FROM abstracts UNION ALL SELECT work_id, NULL, 'missing' FROM works w WHERE status LIKE 'kept%' AND NOT EXISTS (SELECT 1 FROM abstracts a WHERE a.work_id = w.work_id)")
def mark_missing(spark, sf):
    return pending.mark_missing(V.works(spark, sf), V.abstracts(spark, sf))


@query("stale_retraction", D.ctes(D.WORKS) + "SELECT work_id, doi FROM works WHERE status = 'kept_text' AND relevance >= 7 AND (retraction_checked_at IS NULL OR retraction_checked_at < TIMESTAMP '2024-02-04')")
def stale_retraction(spark, sf):
    return pending.retraction(V.works(spark, sf), F.lit("2024-02-04").cast("timestamp_ntz"))


@query("pending_venue", D.ctes(D.WORKS) + "SELECT work_id, doi, pmcid FROM works WHERE status = 'kept_text' AND relevance >= 7 AND venue_source IS NULL")
def pending_venue(spark, sf):
    return pending.venue(V.works(spark, sf))


@query("pending_authors", D.ctes(D.WORKS) + "SELECT work_id, doi, pmcid FROM works WHERE status = 'kept_text' AND relevance >= 7 AND coalesce(trim(authors), '') IN ('', '[]') AND authors_source IS NULL")
def pending_authors(spark, sf):
    return pending.authors(V.works(spark, sf))


# --- joins ----------------------------------------------------------------------------------


@query("load_papers_left_join", WA + "SELECT CAST(w.doc_id AS BIGINT) AS pos, w.work_id, title, abstract FROM works w LEFT JOIN abstracts a ON w.work_id = a.work_id WHERE w.doc_id % 3 = 1")
def load_papers_left_join(spark, sf):
    w = V.works(spark, sf)
    ids = w.filter("doc_id % 3 = 1").select(F.col("doc_id").alias("pos"), "work_id")
    return joins.load_in_order(ids, w.select("work_id", "title"), V.abstracts(spark, sf)).select("pos", "work_id", "title", "abstract")


BUNDLE = D.ctes(D.WORKS, D.GRADED, D.LINES, D.FINDINGS)
LIVE = "status = 'kept_text' AND quality IS NOT NULL"


@query("bundle_works", BUNDLE + f"SELECT work_id, doi, title, CAST(NULL AS VARCHAR) AS venue, year, CASE doc_id % 4 WHEN 1 THEN 'Ann Lee|Bo Chen' WHEN 2 THEN 'Ann Lee|Bo Chen' WHEN 3 THEN 'Ann Lee|Bo Chen.' ELSE '' END AS authors, quality, quality_source, study_type, evidence_grade FROM graded w WHERE {LIVE} AND EXISTS (SELECT 1 FROM findings f WHERE f.work_id = w.work_id)")
def bundle_works(spark, sf):
    w = V.graded(V.works(spark, sf)).withColumn("venue", F.lit(None).cast("string"))
    return publish.live_works(w, V.findings(spark, sf)).withColumn("authors", F.array_join("authors", "|"))


@query("bundle_findings", BUNDLE + f"SELECT f.finding_id, f.work_id, f.claim, f.caveats, l.section, f.quote, f.char_start, f.char_end FROM findings f JOIN lines l ON f.anchor_chunk_id = l.chunk_id JOIN graded w ON w.work_id = f.work_id WHERE {LIVE}")
def bundle_findings(spark, sf):
    f = publish.live_findings(V.graded(V.works(spark, sf)), V.findings(spark, sf), V.lines(spark, sf))
    return f.select("finding_id", "work_id", "claim", "caveats", "anchor.section", "anchor.quote", "anchor.char_start", "anchor.char_end")


@query("tombstones", BUNDLE + f"SELECT work_id, TRUE AS deleted FROM works WHERE doc_id % 4 = 0 AND work_id NOT IN (SELECT work_id FROM graded w WHERE {LIVE} AND EXISTS (SELECT 1 FROM findings f WHERE f.work_id = w.work_id))")
def tombstones(spark, sf):
    w = V.works(spark, sf)
    live = publish.live_works(V.graded(w).withColumn("venue", F.lit(None).cast("string")), V.findings(spark, sf))
    return joins.tombstones(w.filter("doc_id % 4 = 0"), live, "work_id")


@query("ledger_ship", BUNDLE + f"SELECT 'work' AS kind, work_id AS row_id, 'now' AS first_shipped FROM graded w WHERE {LIVE} AND EXISTS (SELECT 1 FROM findings f WHERE f.work_id = w.work_id) AND doc_id % 4 <> 0")
def ledger_ship(spark, sf):
    w = V.works(spark, sf)
    ledger = w.filter("doc_id % 4 = 0").select(F.lit("work").alias("kind"), F.col("work_id").alias("row_id"))
    live = publish.live_works(V.graded(w).withColumn("venue", F.lit(None).cast("string")), V.findings(spark, sf))
    return publish.ship(ledger, live, "work", "work_id", "now")


def _versions(spark, sf):
    w = V.works(spark, sf).select("doc_id", "work_id", "title", "year", "doi")
    before = w.filter("doc_id % 5 <> 0").drop("doc_id")
    after = w.filter("doc_id % 6 <> 1").withColumn("year", F.when(F.col("doc_id") % 8 == 0, F.lit(2030)).otherwise(F.col("year"))).withColumn("doi", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("doi"))).drop("doc_id")
    dead = w.filter("doc_id % 12 = 1").select("work_id")
    return before, after, dead


VERSIONS = D.ctes(D.WORKS, "bef AS (SELECT doc_id, work_id, title, year, doi FROM works WHERE doc_id % 5 <> 0)", "aft AS (SELECT doc_id, work_id, title, CASE WHEN doc_id % 8 = 0 THEN 2030 ELSE year END AS year, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doi END AS doi FROM works WHERE doc_id % 6 <> 1)")
CHANGED = "array_to_string(list_filter([CASE WHEN b.title IS DISTINCT FROM a.title THEN 'title' END, CASE WHEN b.year IS DISTINCT FROM a.year THEN 'year' END, CASE WHEN b.doi IS DISTINCT FROM a.doi THEN 'doi' END], lambda x: x IS NOT NULL), ',')"


@query("snapshot_diff", VERSIONS + f"SELECT coalesce(b.work_id, a.work_id) AS work_id, CASE WHEN b.work_id IS NULL THEN 'added' WHEN a.work_id IS NULL AND b.doc_id % 12 = 1 THEN 'tombstoned' WHEN a.work_id IS NULL THEN 'vanished' WHEN {CHANGED} <> '' THEN 'changed' ELSE 'carried' END AS state, CASE WHEN a.work_id IS NULL OR b.work_id IS NULL THEN '' ELSE {CHANGED} END AS changed FROM bef b FULL JOIN aft a ON a.work_id = b.work_id")
def snapshot_diff(spark, sf):
    before, after, dead = _versions(spark, sf)
    return joins.diff(before, after, "work_id", ["title", "year", "doi"], dead).withColumn("changed", F.array_join("changed", ","))


@query("snapshot_drift", VERSIONS + "SELECT (SELECT count(*) FROM bef b WHERE NOT EXISTS (SELECT 1 FROM aft a WHERE a.work_id = b.work_id)) AS lost, (SELECT count(*) FROM aft a WHERE NOT EXISTS (SELECT 1 FROM bef b WHERE a.work_id = b.work_id)) AS gained")
def snapshot_drift(spark, sf):
    before, after, _ = _versions(spark, sf)
    d = joins.diff(before, after, "work_id", ["year"])
    return d.agg(F.count_if(F.col("state") == "vanished").alias("lost"), F.count_if(F.col("state") == "added").alias("gained"))


@query("changed_fields", VERSIONS + "SELECT field, count(*) AS n FROM (SELECT unnest([CASE WHEN b.year IS DISTINCT FROM a.year THEN 'year' END, CASE WHEN b.doi IS DISTINCT FROM a.doi THEN 'doi' END]) AS field FROM bef b JOIN aft a ON a.work_id = b.work_id) WHERE field IS NOT NULL GROUP BY 1")
def changed_fields(spark, sf):
    before, after, _ = _versions(spark, sf)
    return joins.diff(before, after, "work_id", ["year", "doi"]).select(F.explode("changed").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query("snapshot_audit", VERSIONS + "SELECT work_id, problem FROM (SELECT coalesce(b.work_id, a.work_id) AS work_id, unnest(CASE WHEN b.work_id IS NULL THEN ['not in the snapshot'] WHEN a.work_id IS NULL THEN ['not in the table'] ELSE [CASE WHEN b.year IS DISTINCT FROM a.year THEN 'differs: year' END, CASE WHEN b.doi IS DISTINCT FROM a.doi THEN 'differs: doi' END] END) AS problem FROM bef b FULL JOIN aft a ON a.work_id = b.work_id) WHERE problem IS NOT NULL")
def snapshot_audit(spark, sf):
    before, after, _ = _versions(spark, sf)
    return publish.audit(before, after, "work_id", ["year", "doi"])


@query("bundle_violations", BUNDLE + """, w2 AS (SELECT work_id, quality, CASE WHEN doc_id % 40 = 0 THEN ' ' ELSE quality_source END AS quality_source FROM graded WHERE doc_id % 2 = 0 UNION ALL SELECT work_id, quality, quality_source FROM graded WHERE doc_id % 100 = 2), f2 AS (SELECT finding_id, work_id, claim FROM findings)
SELECT 'work repeats' AS rule, work_id AS key FROM w2 GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'quality out of range', work_id FROM w2 WHERE NOT coalesce(quality BETWEEN 0 AND 1, FALSE)
UNION ALL SELECT 'no quality source', work_id FROM w2 WHERE coalesce(trim(quality_source), '') = '' UNION ALL SELECT 'blank field', finding_id FROM f2 WHERE trim(claim) = ''
UNION ALL SELECT 'parent not shipped', finding_id FROM f2 WHERE work_id NOT IN (SELECT work_id FROM w2) UNION ALL SELECT 'work without findings', work_id FROM w2 WHERE work_id NOT IN (SELECT work_id FROM f2)""")
def bundle_violations(spark, sf):
    w = V.graded(V.works(spark, sf))
    works = w.filter("doc_id % 2 = 0").withColumn("quality_source", F.when(F.col("doc_id") % 40 == 0, " ").otherwise(F.col("quality_source"))).unionByName(w.filter("doc_id % 100 = 2"))
    f = V.findings(spark, sf).withColumn("anchor", F.struct("quote"))
    return publish.violations(works, f)


def _candidates(spark, sf):
    w = V.works(spark, sf)
    i = F.col("doc_id")
    return w.select(i.alias("seq"), F.when(i % 2 == 0, F.concat(F.lit("X"), i)).otherwise(F.col("work_id")).alias("work_id"), F.when(i % 3 == 0, F.col("doi")).alias("doi"), F.when(i % 5 == 0, F.col("pmcid")).alias("pmcid"))


CANDIDATES = "cands AS (SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN 'X' || doc_id ELSE work_id END AS work_id, CASE WHEN doc_id % 3 = 0 THEN doi END AS doi, CASE WHEN doc_id % 5 = 0 THEN pmcid END AS pmcid FROM works)"


@query("seen_any_identifier", D.ctes(D.WORKS, CANDIDATES) + "SELECT DISTINCT seq AS tag FROM cands c JOIN works w ON (w.status <> 'candidate') AND w.status <> 'rejected' AND w.work_id = c.work_id UNION SELECT seq FROM cands c JOIN works w ON w.status <> 'rejected' AND w.doi = c.doi UNION SELECT seq FROM cands c JOIN works w ON w.status <> 'rejected' AND w.pmcid = c.pmcid")
def seen_any_identifier(spark, sf):
    works = V.works(spark, sf).withColumn("status", F.when(F.col("status") == "rejected", "candidate").otherwise(F.col("status")))
    return joins.seen(_candidates(spark, sf), works, "seq")


@query("fill_pmcids", D.ctes(D.WORKS, CANDIDATES) + "SELECT c.seq, c.work_id, coalesce(c.pmcid, w.pmcid) AS pmcid FROM cands c LEFT JOIN works w ON lower(w.doi) = lower(c.doi) AND w.pmcid IS NOT NULL")
def fill_pmcids(spark, sf):
    return joins.fill_pmcids(_candidates(spark, sf), V.works(spark, sf)).select("seq", "work_id", "pmcid")


FIRST_WINS = D.ctes(D.WORKS, "c AS (SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN 'X' || doc_id ELSE work_id END AS work_id, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id // 9 END AS doi, CASE WHEN doc_id % 4 = 0 THEN 'p' || doc_id // 8 END AS pmcid FROM works)",
    "o AS (SELECT *, row_number() OVER (ORDER BY seq) AS k, list_filter(['w' || work_id, 'd' || doi, 'p' || pmcid], lambda x: x IS NOT NULL) AS ids FROM c)",
    "walk AS (SELECT 0::BIGINT AS k, CAST([] AS VARCHAR[]) AS taken, NULL::BIGINT AS seq UNION ALL SELECT o.k, CASE WHEN list_has_any(taken, ids) THEN taken ELSE list_concat(taken, list_filter(ids, lambda x: x[1] <> 'w')) END, CASE WHEN NOT list_has_any(taken, ids) THEN o.seq END FROM walk w JOIN o ON o.k = w.k + 1)").replace("WITH ", "WITH RECURSIVE ", 1)


@query("dedupe_candidates", FIRST_WINS + "SELECT c.* FROM c JOIN walk USING (seq)")
def dedupe_candidates(spark, sf):
    c = _candidates(spark, sf)
    i = F.col("seq")
    c = c.withColumn("doi", F.when(i % 3 == 0, F.concat(F.lit("d"), F.floor(i / 9)))).withColumn("pmcid", F.when(i % 4 == 0, F.concat(F.lit("p"), F.floor(i / 8))))
    return joins.candidates_deduped(c, "seq")


UP = D.ctes(D.WORKS, "old AS (SELECT work_id, title, year FROM works WHERE doc_id % 3 <> 0)", "fresh AS (SELECT work_id, 'new' AS title, year FROM works WHERE doc_id % 4 = 0)")


def _old_new(spark, sf):
    w = V.works(spark, sf)
    return w.filter("doc_id % 3 <> 0").select("work_id", "title", "year"), w.filter("doc_id % 4 = 0").select("work_id", F.lit("new").alias("title"), "year")


@query("upsert_replace", UP + "SELECT * FROM old WHERE work_id NOT IN (SELECT work_id FROM fresh) UNION ALL SELECT * FROM fresh")
def upsert_replace(spark, sf):
    return store.upsert_replace(*_old_new(spark, sf), "work_id")


@query("upsert_ignore", UP + "SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE work_id NOT IN (SELECT work_id FROM old)")
def upsert_ignore(spark, sf):
    return store.upsert_ignore(*_old_new(spark, sf), "work_id")


@query("upsert_if_candidate", D.ctes(D.WORKS, "old AS (SELECT work_id, title, pmcid, CASE WHEN doc_id % 5 = 1 THEN 'candidate' ELSE status END AS status FROM works WHERE doc_id % 3 <> 0)", "fresh AS (SELECT work_id, 'new' AS title, CASE WHEN doc_id % 8 = 0 THEN 'P' END AS pmcid, 'kept_text' AS status FROM works WHERE doc_id % 2 = 0)") + """SELECT coalesce(o.work_id, n.work_id) AS work_id, coalesce(o.title, n.title) AS title,
CASE WHEN o.work_id IS NULL OR (n.work_id IS NOT NULL AND o.status = 'candidate') THEN coalesce(n.pmcid, o.pmcid) ELSE o.pmcid END AS pmcid, CASE WHEN o.work_id IS NULL OR (n.work_id IS NOT NULL AND o.status = 'candidate') THEN n.status ELSE o.status END AS status FROM old o FULL JOIN fresh n ON n.work_id = o.work_id""")
def upsert_if_candidate(spark, sf):
    w = V.works(spark, sf)
    old = w.filter("doc_id % 3 <> 0").select("work_id", "title", "pmcid", F.when(F.col("doc_id") % 5 == 1, "candidate").otherwise(F.col("status")).alias("status"))
    new = w.filter("doc_id % 2 = 0").select("work_id", F.lit("new").alias("title"), F.when(F.col("doc_id") % 8 == 0, "P").alias("pmcid"), F.lit("kept_text").alias("status"))
    return store.record_works(old, new)


@query("judge_update", D.ctes(D.WORKS, D.VERDICTS) + "SELECT w.work_id, CASE WHEN v.work_id IS NULL THEN w.relevance ELSE v.relevance END AS relevance, coalesce(w.study_type, v.study_type) AS study_type, CASE WHEN v.work_id IS NOT NULL THEN CASE WHEN w.study_type IS NULL THEN 'model-a' ELSE 'publisher' END END AS label_source FROM works w LEFT JOIN va v ON v.work_id = w.work_id")
def judge_update(spark, sf):
    w = V.works(spark, sf).withColumns({"label_source": F.lit(None).cast("string"), "label_confidence": F.lit(None).cast("double")})
    return store.apply_verdicts(w, V.verdicts(spark, sf), "model-a").select("work_id", "relevance", "study_type", "label_source")


@query("priority_lookup", D.ctes(D.WORKS) + "SELECT work_id, CASE WHEN doi IS NOT NULL AND doc_id % 4 = 0 THEN 'A' || doc_id WHEN doc_id % 3 = 0 THEN 'B' || doc_id END AS venue, CASE WHEN doi IS NOT NULL AND doc_id % 4 = 0 THEN 'openalex' WHEN doc_id % 3 = 0 THEN 'epmc' ELSE 'missing' END AS source FROM works")
def priority_lookup(spark, sf):
    w = V.works(spark, sf)
    a = w.filter("doc_id % 4 = 0").select(F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), F.concat(F.lit("A"), "doc_id").alias("venue"))
    b = w.filter("doc_id % 3 = 0").select("work_id", F.concat(F.lit("B"), "doc_id").alias("venue"))
    return joins.priority_lookup(w, a, b, "venue")


@query("retraction_or", D.ctes(D.WORKS, "chk AS (SELECT doi IS NOT NULL AND doc_id % 8 = 0 AS a, doc_id % 12 = 0 AS b FROM works)") + "SELECT count(*) AS checked, count(*) FILTER (a OR b) AS retracted, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (b AND NOT a) AS only_second, count(*) FILTER (a AND b) AS both FROM chk")
def retraction_or(spark, sf):
    w = V.works(spark, sf)
    a = w.select("doi", (F.col("doc_id") % 8 == 0).alias("is_retracted"))
    b = w.select("work_id", (F.col("doc_id") % 12 == 0).alias("is_retracted"))
    return joins.retraction_stats(joins.retraction_check(w, a, b))


@query("work_chunks", D.ctes(D.WORKS, D.LINES) + "SELECT w.work_id, count(*) AS n, string_agg(substr(l.text, 1, 5), '|' ORDER BY l.idx) AS heads FROM works w JOIN lines l ON w.work_id = l.work_id WHERE status = 'kept_text' GROUP BY 1")
def work_chunks(spark, sf):
    c = V.lines(spark, sf).withColumn("n_words", F.lit(1))
    w = joins.with_chunks(V.works(spark, sf).filter("status = 'kept_text'").select("work_id"), c)
    return w.select("work_id", F.size("chunks").cast("long").alias("n"), F.array_join(F.transform("chunks", lambda x: F.substring(x["text"], 1, 5)), "|").alias("heads"))


@query("work_budget", "WITH c AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n, sum(len(string_split(text, ' '))) OVER w AS upto, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), o AS (SELECT *, max(CASE WHEN upto > 120 AND r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS over, max(CASE WHEN upto > 120 AND r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS cut FROM c) SELECT CAST(conv_id AS VARCHAR) AS work_id, count(*) AS kept, CAST(sum(n) AS BIGINT) AS words, bool_or(cut = 1) AS truncated FROM o WHERE over = 0 GROUP BY 1")
def work_budget(spark, sf):
    c = V.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("work_id"), F.col("turn").alias("idx"), F.size(F.split("text", " ")).alias("n_words"))
    return joins.work_budget(c, 120).groupBy("work_id").agg(F.count("*").alias("kept"), F.sum("n_words").alias("words"), F.bool_or("truncated").alias("truncated"))


@query("relational_smoke", """SELECT r_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1""")
def relational_smoke(spark, sf):
    t = lambda n: V.table(spark, sf, n)
    li = t("lineitem").join(t("part").filter("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(t("supplier").filter("s_acctbal < 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    j = li.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# --- aggregates -----------------------------------------------------------------------------


@query("status_counts", D.ctes(D.WORKS) + "SELECT status, count(*) AS n FROM works GROUP BY 1")
def status_counts(spark, sf):
    return V.works(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("report_counts", D.ctes(D.WORKS) + "SELECT count(*) FILTER (status = 'kept_text') AS with_text, count(*) AS total FROM works")
def report_counts(spark, sf):
    return V.works(spark, sf).agg(F.count_if(F.col("status") == "kept_text").alias("with_text"), F.count("*").alias("total"))


@query("topic_progress", D.ctes(D.TOPICS) + "SELECT count(*) FILTER (last_crawled_at IS NOT NULL) AS crawled, count(*) AS total FROM topics")
def topic_progress(spark, sf):
    return V.topics(spark, sf).agg(F.count_if(F.col("last_crawled_at").isNotNull()).alias("crawled"), F.count("*").alias("total"))


@query("pass_summary", D.ctes(D.WORKS) + "SELECT o.pos, o.status, count(w.work_id) AS n FROM (VALUES (0, 'candidate'), (1, 'rejected'), (2, 'retracted'), (3, 'kept_miss'), (4, 'kept_text')) o(pos, status) LEFT JOIN works w ON w.status = o.status GROUP BY ALL")
def pass_summary(spark, sf):
    return lifecycle.pass_summary(V.works(spark, sf))


@query("claim_next_topic", D.ctes(D.TOPICS) + "SELECT id, status, last_crawled_at FROM topics WHERE status = 'pending' OR (status = 'done' AND (last_crawled_at < TIMESTAMP '2024-06-01' OR watermark IS NULL OR openalex_cursor IS NOT NULL OR epmc_cursor IS NOT NULL)) ORDER BY status = 'pending' DESC, last_crawled_at NULLS FIRST, id LIMIT 1")
def claim_next_topic(spark, sf):
    return lifecycle.claim_next_topic(V.topics(spark, sf), F.lit("2024-06-01").cast("timestamp_ntz")).select("id", "status", "last_crawled_at")


@query("gate_totals", D.ctes(D.WORKS) + "SELECT count(*) AS n, round(avg(gate_p5), 6) AS mean, count(*) FILTER (gate_p5 >= 0.3) AS at_03, count(*) FILTER (gate_p5 >= 0.5) AS at_05, count(*) FILTER (gate_p5 >= 0.7) AS at_07 FROM works WHERE gate_p5 IS NOT NULL")
def gate_totals(spark, sf):
    g = F.col("gate_p5")
    return V.works(spark, sf).filter(g.isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(g), 6).alias("mean"), *[F.count_if(g >= c).alias(f"at_0{int(c * 10)}") for c in (0.3, 0.5, 0.7)])


@query("gate_by", D.ctes(D.WORKS) + "SELECT \"by\", value, count(*) AS n, round(avg(gate_p5), 6) AS mean, round(avg(CAST(gate_p5 >= 0.3 AS INT)), 6) AS share FROM (SELECT gate_p5, unnest(['status', 'discovered_via', 'domain']) AS \"by\", unnest([status, discovered_via, domain]) AS value FROM works WHERE gate_p5 IS NOT NULL) GROUP BY ALL")
def gate_by(spark, sf):
    w = V.works(spark, sf).filter("gate_p5 is not null")
    each = w.select("gate_p5", F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in ("status", "discovered_via", "domain")])).alias("x"))
    return each.groupBy("x.by", "x.value").agg(F.count("*").alias("n"), F.round(F.avg("gate_p5"), 6).alias("mean"), F.round(F.avg((F.col("gate_p5") >= 0.3).cast("int")), 6).alias("share"))


@query("agreement", D.ctes(D.VERDICTS) + "SELECT count(*) AS n, round(avg(abs(a.relevance - b.relevance)), 6) AS mean_abs_diff, round(avg(CAST(abs(a.relevance - b.relevance) <= 1 AS INT)), 6) AS within_1, round(avg(CAST((a.relevance >= 5) = (b.relevance >= 5) AS INT)), 6) AS keep_agreement, round(avg(CAST(a.domain = b.domain AS INT)), 6) AS domain_agreement, round(avg(CAST(a.study_type = b.study_type AS INT)), 6) AS study_type_agreement FROM va a JOIN vb b ON a.work_id = b.work_id")
def agreement(spark, sf):
    return metrics.agreement(V.verdicts(spark, sf), V.verdicts(spark, sf, True))


@query("disagreements", D.ctes(D.VERDICTS) + "SELECT a.work_id FROM va a JOIN vb b ON a.work_id = b.work_id WHERE abs(a.relevance - b.relevance) >= 2 OR a.domain <> b.domain OR a.study_type <> b.study_type")
def disagreements(spark, sf):
    return metrics.disagreements(V.verdicts(spark, sf), V.verdicts(spark, sf, True))


@query("relevance_histogram", D.ctes(D.VERDICTS) + "SELECT relevance, count(*) AS n FROM va GROUP BY 1")
def relevance_histogram(spark, sf):
    return V.verdicts(spark, sf).groupBy("relevance").agg(F.count("*").alias("n"))


@query("confusion_f1", D.ctes(D.SCORES) + "SELECT n.name, coalesce(round(tp / nullif(claimed, 0), 6), 0) AS precision, coalesce(round(tp / nullif(support, 0), 6), 0) AS recall, coalesce(round(2 * tp / nullif(claimed + support, 0), 6), 0) AS f1, CAST(support AS BIGINT) AS support FROM (SELECT name, CAST(count(*) FILTER (truth = name) AS DOUBLE) AS support, CAST(count(*) FILTER (pred = name) AS DOUBLE) AS claimed, CAST(count(*) FILTER (truth = name AND pred = name) AS DOUBLE) AS tp FROM scores, (VALUES (0), (1)) v(name) GROUP BY 1) n")
def confusion_f1(spark, sf):
    return metrics.per_class(V.scores(spark, sf))


@query("threshold_table", D.ctes(D.SCORES) + "SELECT CAST(t AS DOUBLE) AS threshold, round(avg(CAST(prob >= t AS INT)), 6) AS kept, round(coalesce(CAST(count(*) FILTER (prob >= t AND truth = 1) AS DOUBLE) / nullif(count(*) FILTER (prob >= t), 0), 0), 6) AS precision, round(CAST(count(*) FILTER (prob >= t AND truth = 1) AS DOUBLE) / count(*) FILTER (truth = 1), 6) AS recall FROM scores, (VALUES (CAST(0.3 AS DOUBLE)), (0.4), (0.5), (0.6), (0.7)) v(t) GROUP BY 1")
def threshold_table(spark, sf):
    return metrics.thresholds(V.scores(spark, sf))


@query("roc_auc", D.ctes(D.SCORES) + ", r AS (SELECT truth, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rk FROM scores) SELECT round((sum(rk) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2.0) / (CAST(count(*) FILTER (truth = 1) AS DOUBLE) * count(*) FILTER (truth = 0)), 6) AS auc FROM r")
def roc_auc(spark, sf):
    return metrics.roc_auc(V.scores(spark, sf).withColumn("score", F.col("prob")))


@query("strata_accuracy", D.ctes(D.SCORES) + "SELECT 'toxic' AS stratum, CAST(toxic AS VARCHAR) AS value, count(*) AS n, round(avg(CAST(truth = pred AS INT)), 6) AS accuracy FROM scores GROUP BY ALL UNION ALL SELECT 'truth', CAST(truth AS VARCHAR), count(*), round(avg(CAST(truth = pred AS INT)), 6) FROM scores GROUP BY ALL")
def strata_accuracy(spark, sf):
    return metrics.strata_accuracy(V.scores(spark, sf), ["toxic", "truth"])


@query("token_stats", "WITH t AS (SELECT len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: TRUE)) AS n FROM documents) SELECT round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, round(quantile_cont(n, 0.9), 6) AS p90, CAST(max(n) AS BIGINT) AS most, round(avg(CAST(n > 512 AS INT)), 6) AS share_over FROM t")
def token_stats(spark, sf):
    n = V.table(spark, sf, "documents").select(F.size(T.tokens(F.col("text"))).alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).alias("median"), F.round(F.percentile("n", 0.9), 6).alias("p90"), F.max("n").cast("long").alias("most"), F.round(F.avg((F.col("n") > 512).cast("int")), 6).alias("share_over"))


# --- text -----------------------------------------------------------------------------------


@query("is_heading", D.ctes(D.LINES) + "SELECT chunk_id FROM (SELECT chunk_id, text, trim(regexp_replace(text, '[\\s\\x{85}\\p{Z}]+', ' ', 'g')) AS t FROM lines) WHERE t <> '' AND NOT contains(text, chr(9)) AND length(t) <= 90 AND len(string_split(t, ' ')) <= 10 AND NOT regexp_matches(t, '[.;,]$')")
def is_heading(spark, sf):
    return V.lines(spark, sf).filter(T.is_heading(F.col("text"))).select("chunk_id")


@query("stopword_share", "SELECT doc_id, round(coalesce(CAST(len(list_filter(w, lambda x: list_contains([" + ",".join(f"'{s}'" for s in T.STOPWORDS) + "], x))) AS DOUBLE) / nullif(len(w), 0), 0), 6) AS share FROM (SELECT doc_id, list_filter(list_transform(string_split(trim(regexp_replace(text, '[\\s\\x{85}\\p{Z}]+', ' ', 'g')), ' '), lambda x: lower(trim(x, '.,;:()[]\"''“”'))), lambda x: x <> '') AS w FROM documents)")
def stopword_share(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.round(T.stopword_share(F.col("text")), 6).alias("share"))


@query("is_prose", "SELECT doc_id FROM (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(text, '[\\s\\x{85}\\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '') AS a, list_filter(list_transform(string_split(trim(regexp_replace(text, '[\\s\\x{85}\\p{Z}]+', ' ', 'g')), ' '), lambda x: lower(trim(x, '.,;:()[]\"''“”'))), lambda x: x <> '') AS w FROM documents) WHERE len(regexp_extract_all(text, '[(\\[]\\s*[)\\]]')) < 4 AND (len(a) < 25 OR coalesce(CAST(len(list_filter(w, lambda x: list_contains([" + ",".join(f"'{s}'" for s in T.STOPWORDS) + "], x))) AS DOUBLE) / nullif(len(w), 0), 0) >= 0.08)")
def is_prose(spark, sf):
    return V.table(spark, sf, "documents").filter(T.is_prose(F.col("text"))).select("doc_id")


@query("strip_numbering", D.ctes(D.LINES) + "SELECT chunk_id, trim(regexp_replace(regexp_replace(trim(t), '^\\s*(\\d+(\\.\\d+)*\\.?|[IVXLC]+\\.|[A-Z]\\.)\\s+', ''), ':+$', '')) AS title, regexp_matches(t, '^\\s*\\d+(\\.\\d+)+\\.?\\s+\\S') AS sub FROM (SELECT chunk_id, (idx + 1) || CASE WHEN doc_id % 2 = 0 THEN '.2. ' ELSE '. ' END || substr(text, 1, 30) || ':' AS t FROM lines)")
def strip_numbering(spark, sf):
    numbered = F.concat((F.col("idx") + 1).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".2. ").otherwise(". "), F.substring("text", 1, 30), F.lit(":"))
    return V.lines(spark, sf).select("chunk_id", T.strip_numbering(numbered).alias("title"), T.is_subsection(numbered).alias("sub"))


HEADS = ["Abstract", "2. Materials and Methods", "Results:", "DISCUSSION", "Conclusions", "Funding for the study", "Supplementary data", "Supplementary analyses", "IV. Aims", "Sleep diary"]
NAMED = ["abstract", "methods", "results", "discussion", "conclusion", None, None, None, "introduction", None]
ADMIN = [False] * 5 + [True, True, False, False, False]
_PICK = "list_value({})[doc_id % 10 + 1]"


@query("section_titles", "SELECT doc_id, " + _PICK.format(",".join(f"'{x}'" if x else "NULL" for x in NAMED)) + " AS section, " + _PICK.format(",".join(map(str, ADMIN))) + " AS admin FROM documents")
def section_titles(spark, sf):
    title = F.get(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % 10).cast("int"))
    d = V.table(spark, sf, "documents").select("doc_id", title.alias("t"))
    return d.select("doc_id", T.canonical_section(F.col("t")).alias("section"), T.is_boilerplate(F.col("t")).alias("admin"))


@query("reference_lines", D.ctes(D.LINES) + "SELECT chunk_id FROM (SELECT chunk_id, idx || '. ' || text || CASE WHEN doc_id % 3 = 0 THEN ' 2019' ELSE '' END AS t FROM lines) WHERE length(t) > 60 AND regexp_matches(t, '^\\s*\\d{1,3}[.)]?\\s+') AND regexp_matches(t, '\\b(19|20)\\d{2}\\b')")
def reference_lines(spark, sf):
    t = F.concat("idx", F.lit(". "), "text", F.when(F.col("doc_id") % 3 == 0, " 2019").otherwise(""))
    return V.lines(spark, sf).filter(T.is_reference_line(t)).select("chunk_id")


@query("sentence_split", "SELECT doc_id, count(*) FILTER (trim(s) <> '') AS n, CAST(max(length(s)) AS INT) AS longest FROM (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '[\\s\\x{85}\\p{Z}]+', ' ', 'g'), '([.!?]) ([\"(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS s FROM documents) GROUP BY 1 HAVING n > 0")
def sentence_split(spark, sf):
    s = V.table(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.regexp_replace("text", r"(?U)\s+", " "))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("s")).alias("longest"))


@query("head_abstract", "SELECT doc_id, CASE WHEN length(h) >= 100 THEN h END AS abstract FROM (SELECT doc_id, trim(regexp_replace(substr(text, 1, 2000), '[\\s\\x{85}\\p{Z}]+', ' ', 'g')) AS h FROM documents)")
def head_abstract(spark, sf):
    raw = F.concat(F.lit("front\n\x9f====\x9f"), "text")
    return V.table(spark, sf, "documents").select("doc_id", T.head_abstract(raw).alias("abstract"))


@query("finding_ids", D.ctes(D.LINES) + "SELECT chunk_id, " + D.FINDING_ID.format(w="work_id", t="text") + " AS finding_id FROM lines")
def finding_ids(spark, sf):
    return V.lines(spark, sf).select("chunk_id", T.finding_id(F.col("work_id"), F.col("text")).alias("finding_id"))


@query("locate_quote_exact", "SELECT doc_id, place AS char_start, (place + length(q))::INT AS char_end FROM (SELECT doc_id, q, CASE WHEN q = '' THEN 0 ELSE instr(text, q) - 1 END::INT AS place FROM (SELECT doc_id, text, substr(text, 11, 20) AS q FROM documents))")
def locate_quote_exact(spark, sf):
    return extract.located(V.table(spark, sf, "documents").withColumn("q", F.substring("text", 11, 20)), "doc_id", "text", "q")


LOCATED = r"""WITH d AS (SELECT doc_id, text, replace(substr(text, 11, 50), ' ', chr(10)) AS q FROM documents),
p AS (SELECT *, array_to_string(list_transform(list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '\s+') AS pattern FROM d),
m AS (SELECT *, CASE WHEN instr(text, q) > 0 THEN q WHEN pattern <> '' THEN regexp_extract(text, pattern) END AS found FROM p)
SELECT doc_id, CASE WHEN q = '' THEN 0 WHEN found <> '' THEN instr(text, found) - 1 END::INT AS char_start, CASE WHEN q = '' THEN 0 WHEN found <> '' THEN instr(text, found) - 1 + length(found) END::INT AS char_end FROM m"""


@query("locate_quote_folded", LOCATED)
def locate_quote_folded(spark, sf):
    """Quotes whose spaces became line breaks, so that spans of other spacing are found."""
    return extract.located(V.table(spark, sf, "documents").withColumn("q", F.replace(F.substring("text", 11, 50), F.lit(" "), F.lit("\n"))), "doc_id", "text", "q")


# The order of the tests: over the limit, caveats, quote, repeated claim. Nothing is kept after the eighth.
VALIDATED = D.ctes(D.LINES, """c AS (SELECT work_id, idx, text, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS claim, trim(substr(text, 1, 35), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS quote FROM lines WHERE length(text) BETWEEN 40 AND 280)""",
    r"""j AS (SELECT work_id, idx, lower(regexp_replace(claim, '[\s\x0b]+', ' ', 'g')) AS same, CASE WHEN length(claim) NOT BETWEEN 20 AND 300 THEN 'claim_length' WHEN idx % 4 = 0 THEN 'empty_caveats' WHEN length(quote) NOT BETWEEN 30 AND 1500 THEN 'quote_length' END AS fault FROM c)""",
    "f AS (SELECT *, fault IS NULL AND row_number() OVER (PARTITION BY work_id, same, fault IS NULL ORDER BY idx) = 1 AS fresh FROM j)",
    "n AS (SELECT *, coalesce(sum(fresh::INT) OVER (PARTITION BY work_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)",
    "r AS (SELECT *, CASE WHEN before >= 8 THEN 'over_limit' WHEN fault IS NOT NULL THEN fault WHEN NOT fresh THEN 'duplicate_claim' END AS reason FROM n)")


@query("validate_findings", VALIDATED + "SELECT work_id, count(*) FILTER (reason IS NULL)::INT AS kept, coalesce(string_agg(reason, ',' ORDER BY idx), '') AS reasons FROM r GROUP BY 1")
def validate_findings(spark, sf):
    c = V.lines(spark, sf).filter("length(text) between 40 and 280")
    item = F.to_json(F.struct(F.col("text").alias("claim"), F.when(F.col("idx") % 4 == 0, "none").otherwise("small sample").alias("caveats"), "chunk_id", F.substring("text", 1, 35).alias("quote")))
    raw = c.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("j")))).alias("x"), F.collect_list(F.struct("chunk_id", "text")).alias("chunks"))
    raw = raw.select("work_id", "chunks", F.concat(F.lit("["), F.array_join(F.transform("x", lambda s: s["j"]), ","), F.lit("]")).alias("raw"))
    return extract.validated(raw).select("work_id", F.size("findings").alias("kept"), F.array_join(F.transform("drops", lambda d: d["reason"]), ",").alias("reasons"))


@query("strip_markup", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '</h\\d>', ': ', 'g'), '<[^>]+>', ' ', 'g'), '[\\s\\x{85}\\p{Z}]+', ' ', 'g')) AS plain FROM pages")
def strip_markup(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", T.plain(F.col("html")).alias("plain"))


@query("match_terms", "SELECT item_id, array_to_string(list_transform(" + D.TOKENS.format(t="text", n=3) + ", lambda x: '\"' || x || '\"'), ' OR ') AS expression FROM benchmark")
def match_terms(spark, sf):
    return V.table(spark, sf, "benchmark").select("item_id", T.match_expression(F.col("text")).alias("expression"))


@query("json_verdicts", "SELECT doc_id // 3 AS batch_id, CAST(doc_id % 3 + 1 AS INT) AS paper, CAST(doc_id % 11 AS INT) AS relevance FROM documents WHERE doc_id // 3 IN (SELECT doc_id // 3 FROM documents GROUP BY 1 HAVING count(*) = 3 AND bool_and(doc_id % 7 <> 6))")
def json_verdicts(spark, sf):
    i = F.col("doc_id")
    e = F.struct((i % 3 + 1).cast("int").alias("paper"), (i % 11).cast("int").alias("relevance"), F.when(i % 7 == 6, "elsewhere").otherwise("sleep").alias("domain"), F.lit("rct").alias("study_type"), F.lit(0.5).alias("confidence"))
    b = V.table(spark, sf, "documents").groupBy(F.floor(i / 3).alias("batch_id")).agg(F.array_sort(F.collect_list(e)).alias("x"))
    return extract.verdicts(b.select("batch_id", F.lit(3).alias("n"), F.to_json("x").alias("reply")), list(R.GRADES), list(R.DOMAINS)).select("batch_id", "paper", "relevance")


@query("prompt_blocks", "SELECT doc_id // 4 AS batch_id, string_agg('Paper ' || (doc_id % 4 + 1) || chr(10) || 'Title: ' || substr(text, 1, 60) || chr(10) || 'Year: ' || coalesce(CAST(CASE WHEN doc_id % 17 <> 0 THEN 1990 + doc_id % 36 END AS VARCHAR), 'unknown') || chr(10) || 'Abstract: ' || substr(text, 1, 1500), chr(10) || chr(10) ORDER BY doc_id) AS prompt FROM documents GROUP BY 1")
def prompt_blocks(spark, sf):
    i = F.col("doc_id")
    p = V.table(spark, sf, "documents").select(i.alias("pos"), F.substring("text", 1, 60).alias("title"), F.when(i % 17 != 0, (1990 + i % 36).cast("int")).alias("year"), F.col("text").alias("abstract"))
    return extract.paper_prompts(p, 4)


@query("clean_blocks")
def clean_blocks(spark, sf):
    return clean.clean(V.table(spark, sf, "documents")).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")


@query("drop_reasons")
def drop_reasons(spark, sf):
    return clean.clean(V.table(spark, sf, "documents")).select(F.explode("dropped").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


def _paragraphed(spark, sf):
    return V.table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", "\n", "\n\n"))


@query("chunk_documents")
def chunk_documents(spark, sf):
    return clean.chunk(_paragraphed(spark, sf))


@query("chunk_section_counts")
def chunk_section_counts(spark, sf):
    return clean.chunk(_paragraphed(spark, sf)).groupBy("section").agg(F.count("*").alias("n"))


@query("chunk_word_stats")
def chunk_word_stats(spark, sf):
    return clean.chunk(_paragraphed(spark, sf)).agg(F.count("*").alias("n"), F.round(F.avg("n_words"), 4).alias("mean"), F.min("n_words").alias("least"), F.max("n_words").alias("most"))


# --- retrieval ------------------------------------------------------------------------------


@query("term_stats", D.ctes(D.QUERIES, D.BM25) + "SELECT term, df FROM df")
def term_stats(spark, sf):
    return lexical.index(V.table(spark, sf, "documents"), "doc_id", "text")["term_stats"]


@query("bm25_topk", D.ctes(D.QUERIES, D.BM25) + "SELECT qid, doc, score, rank FROM lex")
def bm25_topk(spark, sf):
    return lexical.search(lexical.index(V.table(spark, sf, "documents"), "doc_id", "text"), V.queries(spark, sf), 10)


@query("bm25_stemmed")
def bm25_stemmed(spark, sf):
    return lexical.search(lexical.index(V.table(spark, sf, "documents"), "doc_id", "text", True), V.queries(spark, sf), 10, True)


def _vectors(spark, sf):
    v = V.table(spark, sf, "embeddings")
    return v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query("knn_batch", D.ctes(D.DENSE) + "SELECT qid, vec_id, score, rank FROM knn")
def knn_batch(spark, sf):
    return vector.topk(*_vectors(spark, sf), 10)


@query("dense_topk", "SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7)), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk(spark, sf):
    v = V.table(spark, sf, "embeddings")
    return vector.topk_one(v, v.filter("vec_id = 7").first()["embedding"], 10)


@query("knn_by_distance", D.ctes("qv AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)") + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (SELECT qid, vec_id, round(-list_sum(list_transform(list_zip(embedding, q), lambda x: pow(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2))), 6) AS score FROM embeddings, qv)) WHERE rank <= 10")
def knn_by_distance(spark, sf):
    return vector.topk(*_vectors(spark, sf), 10, by="distance")


@query("recall_at_k", D.ctes(D.DENSE) + "SELECT round(avg(len(list_intersect(g, t)) / CAST(len(t) AS DOUBLE)), 6) AS recall, count(*) AS queries FROM (SELECT qid, list(vec_id) AS t, list(vec_id) FILTER (vec_id % 2 = 0) AS g FROM knn GROUP BY 1)")
def recall_at_k(spark, sf):
    truth = vector.topk(*_vectors(spark, sf), 10)
    return vector.recall(truth.filter("vec_id % 2 = 0"), truth)


@query("ivf_probe")
def ivf_probe(spark, sf):
    return vector.ivf(*_vectors(spark, sf), 10, probes=16, min_recall=0.9)


@query("ivf_recall")
def ivf_recall(spark, sf):
    return vector.recall(ivf_probe(spark, sf), vector.topk(*_vectors(spark, sf), 10))


@query("synthetic_vectors")
def synthetic_vectors(spark, sf):
    v = V.table(spark, sf, "embeddings")
    return vector.synthetic(v, 3 * v.count()).select("vec_id", "copy", F.round(vector.norm(F.col("embedding")), 4).alias("norm"))


@query("mean_pool_normalize", "SELECT vec_id, round(m / greatest(sqrt(m * m + n * n), 1e-12), 6) AS first FROM (SELECT vec_id, (CAST(embedding[1] AS DOUBLE) + CAST(embedding[3] AS DOUBLE)) / 2.0 AS m, (CAST(embedding[2] AS DOUBLE) + CAST(embedding[4] AS DOUBLE)) / 2.0 AS n FROM embeddings)")
def mean_pool_normalize(spark, sf):
    v = V.table(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    states = F.array(F.slice("e", 1, 2), F.slice("e", 3, 2), F.slice("e", 5, 2))
    return v.select("vec_id", F.round(F.get(vector.pool(states, F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0))), 0), 6).alias("first"))


@query("embed_documents")
def embed_documents(spark, sf):
    return vector.embed(V.table(spark, sf, "documents"), vector.hash_encoder(64), "doc_id", "text").select("doc_id", F.round(vector.norm(F.col("embedding")), 4).alias("norm"))


def _arms(spark, sf):
    lex = bm25_topk(spark, sf).select("qid", F.lit(0).alias("arm"), "rank", "doc")
    q = V.queries(spark, sf)
    short = q.withColumn("query", F.substring("query", 1, 40))
    second = lexical.search(lexical.index(V.table(spark, sf, "documents"), "doc_id", "text"), short, 10).select("qid", F.lit(1).alias("arm"), "rank", "doc")
    return lex.unionByName(second)


ARMS = D.ctes(D.QUERIES, D.BM25, "asked2 AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(" + D.TOKENS.format(t="substr(query, 1, 40)", n=3) + ") AS term FROM queries) GROUP BY ALL)", "weighed2 AS (SELECT qid, term, times, avgdl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM asked2 JOIN df USING (term), whole)", "bm2 AS (SELECT qid, doc, round(sum(times * idf * CAST(tf AS DOUBLE) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM postings JOIN weighed2 USING (term) JOIN dl USING (doc) GROUP BY ALL)", "lex2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM bm2) WHERE rank <= 10)", "arms AS (SELECT qid, 0 AS arm, rank, doc FROM lex UNION ALL SELECT qid, 1, rank, doc FROM lex2)", "fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS rank FROM (SELECT qid, doc, round(sum(1.0 / (60 + rank)), 9) AS score, min((arm, rank)) AS seen FROM arms GROUP BY ALL))")


@query("rrf_fusion", ARMS + "SELECT qid, doc, score, rank FROM fused WHERE rank <= 10")
def rrf_fusion(spark, sf):
    return rank.rrf(_arms(spark, sf), 10)


@query("candidate_union", ARMS + "SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY seen) AS pos FROM fused")
def candidate_union(spark, sf):
    return rank.union(_arms(spark, sf))


def _hybrid(spark, sf, depth: int = 50):
    """The lexical and the dense arm, each over all documents for whole queries."""
    docs, q, encode = V.table(spark, sf, "documents"), V.queries(spark, sf), vector.hash_encoder(64)
    lex = lexical.search(lexical.index(docs, "doc_id", "text"), q, depth).select("qid", F.lit(0).alias("arm"), "rank", "doc")
    near = vector.topk(vector.embed(docs, encode, "doc_id", "text"), vector.embed(q, encode, "qid", "query"), depth, key="doc_id")
    return lex.unionByName(near.select("qid", F.lit(1).alias("arm"), "rank", F.col("doc_id").alias("doc")))


@query("hybrid_fusion")
def hybrid_fusion(spark, sf):
    return rank.rrf(_hybrid(spark, sf), 10)


@query("hybrid_union")
def hybrid_union(spark, sf):
    return rank.union(_hybrid(spark, sf))


@query("hybrid_p_at_k")
def hybrid_p_at_k(spark, sf):
    return metrics.precision_at(hybrid_fusion(spark, sf), V.judged(spark, sf), V.queries(spark, sf), 10)


@query("rerank_topk")
def rerank_topk(spark, sf):
    c = rank.union(_hybrid(spark, sf)).join(V.queries(spark, sf), "qid").join(V.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    return vector.rerank(c, vector.overlap_scorer, 5)


@query("eval_p_at_k", ARMS.rstrip() + f",\n{D.JUDGED}, hits AS (SELECT f.qid, f.rank, j.relevant FROM fused f LEFT JOIN judged j ON f.qid = j.qid AND f.doc = j.doc WHERE f.rank <= 10), per AS (SELECT q.qid, coalesce(sum(relevant), 0) / 10.0 AS pk, coalesce(sum(relevant) FILTER (rank <= 3), 0) / 3.0 AS p3, coalesce(max(relevant) FILTER (rank <= 3), 0) AS h3, count(rank) FILTER (relevant IS NULL) AS u FROM queries q LEFT JOIN hits h ON q.qid = h.qid GROUP BY 1) SELECT count(*) AS queries, round(avg(pk), 6) AS p_at_k, round(avg(p3), 6) AS p_at_3, CAST(sum(h3) AS BIGINT) AS hit_at_3, CAST(sum(u) AS BIGINT) AS unjudged FROM per")
def eval_p_at_k(spark, sf):
    return metrics.precision_at(rank.rrf(_arms(spark, sf), 10), V.judged(spark, sf), V.queries(spark, sf), 10)


@query("logreg_gate")
def logreg_gate(spark, sf):
    """Verdicts on the held-out fifth of the vectors, from a fit on the others."""
    v = V.table(spark, sf, "embeddings").withColumn("truth", (F.col("label") < 5).cast("int"))
    marked = sampling.split(v, "truth", "vec_id")
    return distill.apply(distill.fit(marked.filter("not is_test")), marked.filter("is_test")).select("vec_id", "truth", "prob", "pred")


# --- streams --------------------------------------------------------------------------------


@query("events_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_windows(spark, sf):
    w = events.windows(V.table(spark, sf, "events"))
    return w.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("events_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM s GROUP BY user_id, s.s")
def events_sessions(spark, sf):
    w = events.sessions(V.table(spark, sf, "events"))
    return w.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("citation_expansion", D.ctes(D.WORKS, "wk AS (SELECT work_id, 'W' || doc_id AS oid, doc_id FROM works WHERE doc_id % 3 <> 0 AND status LIKE 'kept%')", "seeds AS (SELECT oid FROM wk ORDER BY work_id LIMIT 10)", "edges AS (SELECT 'W' || doc_id AS src, p AS pos, 'W' || (doc_id + 1 + p) AS dst FROM documents, range(12) r(p))") + "SELECT DISTINCT openalex_id FROM (SELECT dst AS openalex_id FROM edges WHERE src IN (SELECT oid FROM seeds) AND pos < 10 UNION SELECT src FROM edges WHERE dst IN (SELECT oid FROM seeds)) WHERE openalex_id NOT IN (SELECT oid FROM wk)")
def citation_expansion(spark, sf):
    w = V.works(spark, sf).filter("doc_id % 3 <> 0 and status like 'kept%'").withColumn("openalex_id", F.col("work_id")).withColumn("expanded_at", F.lit(None).cast("timestamp"))
    d = V.table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos"))
    edges = d.select(F.concat(F.lit("W"), "doc_id").alias("src"), "pos", F.concat(F.lit("W"), F.col("doc_id") + 1 + F.col("pos")).alias("dst"))
    return lifecycle.expansion(w, edges)


# --- services, reports, cards ---------------------------------------------------------------


@query("abstracts_by_source", WA + "SELECT source, count(*) AS n, count(abstract) AS filled FROM abstracts GROUP BY 1")
def abstracts_by_source(spark, sf):
    return V.abstracts(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count("abstract").alias("filled"))


@query("status_message", D.ctes(D.WORKS) + "SELECT count(*) FILTER (status = 'kept_text') AS with_text, count(*) AS total FROM works")
def status_message(spark, sf):
    return service.status_counts(V.works(spark, sf))


@query("usage_totals", "SELECT sum(event_id % 1000) AS input_tokens, sum(event_id % 70) AS output_tokens, sum(event_id % 31) AS cache_read_tokens, 0 AS cost_usd, sum(event_id % 9) AS seconds FROM events")
def usage_totals(spark, sf):
    i = F.col("event_id")
    e = V.table(spark, sf, "events").select((i % 1000).alias("input_tokens"), (i % 70).alias("output_tokens"), (i % 31).alias("cache_read_tokens"), F.lit(None).cast("int").alias("cost_usd"), (i % 9).alias("seconds"))
    return service.usage_total(e).select("input_tokens", "output_tokens", "cache_read_tokens", F.col("cost_usd").cast("int").alias("cost_usd"), "seconds")


@query("journal_titles", "SELECT lower('10.1/A' || doc_id) AS doi, 'PMC' || doc_id AS pmcid, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'Sleep ' || doc_id END AS venue FROM documents")
def journal_titles(spark, sf):
    i = F.col("doc_id")
    title = F.when(i % 4 == 1, "  ").when(i % 4 != 0, F.concat(F.lit(" Sleep "), i))
    record = F.to_json(F.struct(F.concat(F.lit("10.1/A"), i).alias("doi"), F.concat(F.lit("pmc"), i).alias("pmcid"), F.struct(F.struct(title.alias("title")).alias("journal")).alias("journalInfo")))
    return records.journals(V.table(spark, sf, "documents").select(record.alias("json")))


@query("claim_cards", BUNDLE + f"SELECT f.finding_id, f.work_id, f.claim, f.caveats, w.quality, w.title FROM findings f JOIN graded w ON w.work_id = f.work_id WHERE {LIVE}")
def claim_cards(spark, sf):
    w = V.graded(V.works(spark, sf)).withColumn("venue", F.lit(None).cast("string"))
    f = V.findings(spark, sf)
    return publish.cards(publish.live_works(w, f), f)


@query("quota_waits", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 0.0 WHEN doc_id % 100 > 85 THEN greatest(doc_id % 400 - 100, 0) + 60.0 ELSE 0.0 END::DOUBLE AS wait,
CASE WHEN doc_id % 5 = 0 THEN 1800.0 WHEN doc_id % 400 >= 100 THEN doc_id % 400 - 100 + 60.0 ELSE doc_id % 400 - 100 + 18000 + 60.0 END::DOUBLE AS reset FROM documents""")
def quota_waits(spark, sf):
    """Status files of which a fifth is malformed and a seventh stale."""
    i = F.col("doc_id")
    window = F.struct((i % 100).alias("used_percentage"), (i % 400).alias("resets_at"))
    text = F.when(i % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.struct(window.alias("five_hour")).alias("rate_limits"))))
    d = V.table(spark, sf, "documents").select("doc_id", text.alias("s"))
    return d.select("doc_id", service.quota_wait(F.col("s"), F.when(i % 7 == 0, 5000).otherwise(10), F.lit(100.0)).alias("wait"), service.next_reset(F.col("s"), F.lit(100.0)).alias("reset"))


@query("triage_replies", "SELECT doc_id // 3 AS batch_id, CAST(doc_id % 3 AS INT) AS place, doc_id % 2 = 0 AS relevant, CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence FROM documents WHERE doc_id // 3 IN (SELECT doc_id // 3 FROM documents GROUP BY 1 HAVING count(*) = 3 AND bool_and(doc_id % 11 <> 6))")
def triage_replies(spark, sf):
    """Wrapped and fenced replies to three papers each; those with an unknown study type count for none."""
    i = F.col("doc_id")
    e = F.struct(i.alias("i"), F.struct((i % 2 == 0).alias("relevant"), F.when(i % 11 == 6, "letter").otherwise("rct").alias("study_type"), ((i % 10).cast("double") / 10).alias("confidence")).alias("v"))
    b = V.table(spark, sf, "documents").groupBy(F.floor(i / 3).alias("batch_id")).agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x["v"]).alias("x"))
    wrapped = F.to_json(F.struct(F.lit(False).alias("is_error"), F.concat(F.lit("```json\n"), F.to_json("x"), F.lit("\n```")).alias("result")))
    return service.triage_verdicts(b.select("batch_id", F.lit(3).alias("n"), service.reply_text(wrapped).alias("reply")), list(R.GRADES)).select("batch_id", "place", "relevant", "confidence")


@query("enrich_venues", D.ctes(D.WORKS) + "SELECT work_id, CASE WHEN venue_source IS NULL AND doc_id % 3 = 0 THEN 'Journal ' || (doc_id % 10) END AS venue, CASE WHEN venue_source IS NOT NULL THEN venue_source WHEN doc_id % 3 = 0 THEN 'epmc' ELSE 'missing' END AS venue_source FROM works")
def enrich_venues(spark, sf):
    w = V.works(spark, sf).select("doc_id", "work_id", F.lit(None).cast("string").alias("venue"), "venue_source")
    answers = service.looked_up(w.filter("venue_source is null").select("doc_id", "work_id"), lambda rows: {r["work_id"]: f"Journal {r['doc_id'] % 10}" for r in rows if r["doc_id"] % 3 == 0}, "venue")
    return service.enrich(w, answers, "venue", "epmc").select("work_id", "venue", "venue_source")


@query("topic_by_id", D.ctes(D.TOPICS) + "SELECT * FROM topics WHERE id = 7")
def topic_by_id(spark, sf):
    return lifecycle.topic(V.topics(spark, sf), 7)


@query("latency_statistics", "SELECT event_type, v[len(v) // 2 + 1] AS p50, v[floor(0.95 * len(v))::INT + 1] AS p95 FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1)")
def latency_statistics(spark, sf):
    return metrics.order_statistics(V.table(spark, sf, "events"), "event_type", "value")
