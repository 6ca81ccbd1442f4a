"""DuckDB twins of the views, as common table expressions."""

from __future__ import annotations

from vellum.functions import records as R

TYPES = "[" + ",".join(f"'{t}'" for t in R.GRADES) + "]"
DOMAINS = "[" + ",".join(f"'{t}'" for t in R.DOMAINS) + "]"
GRADE = "CASE {} " + " ".join(f"WHEN '{t}' THEN {g}" for t, g in R.GRADES.items()) + " END"

WORKS = f"""works0 AS (SELECT d.doc_id, d.text, l.quality AS lq, CASE WHEN d.doc_id % 5 <> 0 THEN {TYPES}[d.doc_id % 11 + 1] END AS study_type
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
works AS (SELECT doc_id, 'W' || doc_id AS work_id, substr(text, 1, 60) AS title,
  CASE WHEN doc_id % 17 <> 0 THEN CAST(1990 + doc_id % 36 AS INT) END AS year,
  CASE WHEN doc_id % 6 <> 0 THEN '10.1000/AbC' || doc_id END AS doi,
  CASE WHEN doc_id % 4 <> 0 THEN 'PMC' || doc_id END AS pmcid,
  CASE doc_id % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'europepmc' ELSE 'citation' END AS discovered_via,
  CASE WHEN doc_id % 10 < 6 THEN 'kept_text' WHEN doc_id % 10 < 8 THEN 'kept_miss' WHEN doc_id % 10 = 8 THEN 'rejected' ELSE 'retracted' END AS status,
  study_type, CASE WHEN doc_id % 8 = 0 THEN {GRADE.format('study_type')} END AS evidence_grade,
  CAST(lq * 6 + doc_id % 5 AS INT) AS relevance, CASE WHEN lq IS NULL THEN CAST(doc_id % 100 AS DOUBLE) / 100.0 END AS gate_p5,
  CASE doc_id % 4 WHEN 1 THEN 'Ann Lee; Bo Chen' WHEN 2 THEN '["Ann Lee"," Bo Chen ",""]' WHEN 3 THEN 'Ann Lee, Bo Chen.' END AS authors,
  CASE WHEN doc_id % 10 < 6 THEN '/texts/W' || doc_id || '.txt' END AS text_path,
  CASE WHEN doc_id % 9 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS chunked_at,
  CASE WHEN doc_id % 12 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS extracted_at,
  CASE WHEN doc_id % 13 < 6 THEN TIMESTAMP '2024-02-01' + to_days(CAST(doc_id % 13 AS INT)) END AS retraction_checked_at,
  CASE WHEN doc_id % 7 = 0 THEN 'openalex' END AS venue_source, CASE WHEN doc_id % 14 = 0 THEN 'openalex' END AS authors_source,
  {DOMAINS}[doc_id % 7 + 1] AS domain FROM works0)"""

QUALITY = "round(greatest(0.0, least(1.0, (CASE WHEN relevance IS NOT NULL THEN CAST(relevance AS DOUBLE) / 10.0 ELSE gate_p5 * CAST(0.69 AS DOUBLE) END) * (CAST(1.0 AS DOUBLE) - CAST(0.06 AS DOUBLE) * (coalesce({g}, 1) - 1)))), 4)"
SOURCE = "CASE WHEN relevance IS NOT NULL THEN 'judge' WHEN gate_p5 IS NOT NULL THEN 'gate' END"
FULL = f"coalesce(evidence_grade, {GRADE.format('study_type')})"
GRADED = f"graded AS (SELECT * REPLACE ({FULL} AS evidence_grade), CASE WHEN relevance IS NOT NULL OR gate_p5 IS NOT NULL THEN {QUALITY.format(g=FULL)} END AS quality, {SOURCE} AS quality_source FROM works)"

ABSTRACTS = "abstracts AS (SELECT 'W' || doc_id AS work_id, CASE WHEN doc_id % 19 <> 0 THEN substr(text, 1, 2000) END AS abstract, 'text' AS source FROM documents WHERE doc_id % 7 <> 0)"
LINES = """lines0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents),
lines AS (SELECT doc_id, 'W' || doc_id AS work_id, 'W' || doc_id || '#' || idx AS chunk_id, CAST(idx AS INT) AS idx, text, CASE WHEN idx % 2 = 0 THEN 'methods' ELSE 'results' END AS section FROM lines0)"""
FINDING_ID = "'f_' || substr(sha256({w} || chr(10) || lower(trim(regexp_replace({t}, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g')))), 1, 16)"
FINDINGS = f"""findings AS (SELECT DISTINCT ON (finding_id) * FROM (SELECT {FINDING_ID.format(w='work_id', t='text')} AS finding_id, work_id, text AS claim, 'small sample' AS caveats, chunk_id AS anchor_chunk_id, 0 AS char_start, 10 AS char_end, substr(text, 1, 10) AS quote
  FROM lines WHERE length(text) BETWEEN 20 AND 300 AND idx % 3 = 0 AND doc_id % 10 < 6))"""
VERDICTS = f"""va AS (SELECT 'W' || doc_id AS work_id, CAST(quality * 6 + doc_id % 3 AS INT) AS relevance, {DOMAINS}[doc_id % 7 + 1] AS domain, {TYPES}[doc_id % 11 + 1] AS study_type FROM labels),
vb AS (SELECT 'W' || doc_id AS work_id, CAST(quality * 6 + doc_id % 3 + doc_id % 4 AS INT) AS relevance, {DOMAINS}[(doc_id + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END) % 7 + 1] AS domain, {TYPES}[(doc_id + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) % 11 + 1] AS study_type FROM labels WHERE doc_id % 9 <> 0)"""
TOPICS = """topics AS (SELECT user_id AS id, CASE kind WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'active' ELSE 'done' END AS status,
  CASE WHEN n % 3 <> 0 THEN last END AS last_crawled_at, CASE WHEN n % 2 = 0 THEN CAST(last AS DATE) END AS watermark, CASE WHEN n % 5 = 0 THEN 'c1' END AS openalex_cursor, CAST(NULL AS VARCHAR) AS epmc_cursor
  FROM (SELECT user_id, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS kind, count(*) AS n FROM events GROUP BY 1))"""
SCORES = "scores AS (SELECT doc_id, quality AS truth, CAST(quality * 30 + doc_id * 7 % 71 AS DOUBLE) / 100.0 AS prob, CASE WHEN CAST(quality * 30 + doc_id * 7 % 71 AS DOUBLE) / 100.0 >= 0.5 THEN 1 ELSE 0 END AS pred, toxic FROM labels)"
TOKENS = "list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda x: length(x) >= {n})"
QUERIES = "queries AS (SELECT item_id + 1 AS qid, text AS query FROM benchmark)"
JUDGED = "judged AS (SELECT DISTINCT qid, doc_id AS doc, 1 AS relevant FROM queries JOIN documents ON contains(text, substr(query, 1, 60)))"
BM25 = f"""postings AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format(t='text', n=1)}) AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id AS doc, len({TOKENS.format(t='text', n=1)}) AS dl FROM documents), whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
asked AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({TOKENS.format(t='query', n=3)}) AS term FROM queries) GROUP BY ALL),
weighed AS (SELECT qid, term, times, avgdl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM asked JOIN df USING (term), whole),
bm AS (SELECT qid, doc, round(sum(times * idf * CAST(tf AS DOUBLE) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM postings JOIN weighed USING (term) JOIN dl USING (doc) GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM bm) WHERE rank <= 10)"""
DENSE = """qv AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
dotted AS (SELECT qid, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS score FROM embeddings, qv),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM dotted) WHERE rank <= 10)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
