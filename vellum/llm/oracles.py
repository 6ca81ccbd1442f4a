"""DuckDB twins of the queries that SQL can express, each over the whole tables."""

from __future__ import annotations

from vellum.llm import license_scan, line_dedup, secret_scan, sharding

# CRC-32 over a list of byte values, by a table of its polynomial (reflected) that SQL derives.
_CRC_TABLE = """
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) x(i))
"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"""


def _place(of: str) -> str:
    return f"('0x' || substr(md5({of}), 1, 8))::BIGINT"


OP9 = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
nodes AS (SELECT {_place("s::VARCHAR || ':' || v::VARCHAR")} AS pos, min(s) AS shard FROM range({sharding.SHARDS}) a(s), range({sharding.VNODES}) b(v) GROUP BY 1),
arcs AS (SELECT pos, shard, row_number() OVER (ORDER BY pos) - 1 AS arc, count(*) OVER () AS n_arcs FROM nodes),
docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {_CRC} AS text_crc32, {_place("coalesce(text, '')")} AS pos FROM documents, crc),
placed AS (SELECT d.*, coalesce(a.arc, 0) AS arc FROM docs d ASOF LEFT JOIN arcs a ON d.pos <= a.pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY pos, doc_id NULLS FIRST, size, text_crc32) - 1 AS rnk FROM placed),
quotas AS (SELECT s AS shard, n // {sharding.SHARDS} + (s < n % {sharding.SHARDS})::BIGINT AS quota FROM range({sharding.SHARDS}) a(s), (SELECT count(*) AS n FROM documents)),
counts AS (SELECT arc, a.shard, quota, n, sum(n) OVER (PARTITION BY a.shard ORDER BY arc) - n AS before, n_arcs
    FROM (SELECT arc, count(*) AS n FROM placed GROUP BY arc) JOIN arcs a USING (arc) JOIN quotas USING (shard)),
home AS (SELECT arc, 0 AS lo, least(n, greatest(quota - before, 0)) AS hi, shard, before AS slot FROM counts),
rooms AS (SELECT list(quota - coalesce(held, 0) ORDER BY shard) AS room, list(quota ORDER BY shard) AS quota
    FROM quotas LEFT JOIN (SELECT shard, sum(hi) AS held FROM home GROUP BY shard) USING (shard)),
waiting AS (SELECT row_number() OVER (ORDER BY arc) AS i, arc, hi AS lo, n - hi AS n, n_arcs FROM counts JOIN home USING (arc) WHERE n > hi),
ways AS (SELECT i, any_value(w.arc) AS arc, any_value(lo) AS lo, any_value(n) AS n, list(d ORDER BY shard) AS ways
    FROM (SELECT w.*, a.shard, min((a.arc - w.arc - 1 + w.n_arcs) % w.n_arcs) AS d FROM waiting w, arcs a GROUP BY ALL) w GROUP BY i),
walk AS (
    SELECT 0::BIGINT AS i, 0::BIGINT AS arc, 0::HUGEINT AS lo, 0::HUGEINT AS hi, 0::BIGINT AS shard, 0::HUGEINT AS slot, 0::HUGEINT AS rest, room::HUGEINT[] AS room FROM rooms
    UNION ALL
    SELECT i, arc, lo, lo + took, s - 1, quota[s] - room[s], rest - took, list_transform(room, lambda x, k: CASE WHEN k = s THEN x - took ELSE x END)
    FROM (SELECT *, least(rest, room[s]) AS took FROM (
        SELECT y.i, y.arc, CASE WHEN x.rest > 0 THEN x.hi ELSE y.lo END AS lo, CASE WHEN x.rest > 0 THEN x.rest ELSE y.n END AS rest, x.room, q.quota,
            list_sort(list_filter(list_transform(y.ways, lambda d, k: {{'d': d, 's': k}}), lambda o: x.room[o.s] > 0))[1].s AS s
        FROM walk x JOIN ways y ON y.i = CASE WHEN x.rest > 0 THEN x.i ELSE x.i + 1 END, rooms q)))
SELECT doc_id, size, text_crc32, 'rows' AS law, s.shard::INT AS shard, (s.slot + r.rnk - s.lo)::BIGINT AS slot, NULL::INT AS grown_shard
FROM ranked r JOIN (SELECT arc, lo, hi, shard, slot FROM home UNION ALL SELECT arc, lo, hi, shard, slot FROM walk WHERE i > 0) s ON r.arc = s.arc AND s.lo <= r.rnk AND r.rnk < s.hi
"""


def _either(word: str) -> str:
    """An ASCII word in either case; RE2's own flag would fold further letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _matches(kind: int, pattern: str, keep: str, group: int = 0) -> str:
    """rid, kind, start, end of the matches m (group g) of a pattern in all texts."""
    lit = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT rid, {kind} AS kind, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM (
        SELECT rid, m, g, sum(length(p) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS e FROM (
            SELECT rid, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(ps[1:len(ms)]) AS p FROM (
                SELECT rid, regexp_extract_all(t, {lit}) AS ms, regexp_extract_all(t, {lit}, {group}) AS gs, regexp_split_to_array(t, {lit}) AS ps FROM docs) WHERE len(ms) > 0)) WHERE {keep}"""


_WORDS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_ASSIGN = rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_RENDER = "coalesce(string_agg(['assign', 'access', 'hex', 'key', 'endpoint'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e), '')"

OP6 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_matches(0, _ASSIGN, "length(g) >= 6", 2)} UNION ALL {_matches(1, "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {_matches(2, "[0-9a-f]+", "length(m) >= 24")}),
weak AS ({_matches(3, secret_scan.RUN, "length(m) = 40 AND NOT contains(m, '=') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')")}
    UNION ALL {_matches(4, secret_scan.ENDPOINT, "g = '' OR length(g) BETWEEN 2 AND 5", 1)}),
linked AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND abs(b.s - w.s) <= {secret_scan.SCOPE} AND (b.kind = 1 OR w.kind = 4))),
b AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {_RENDER} AS r FROM base GROUP BY rid),
every AS (SELECT rid, {_RENDER} AS r FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.r, '')) AS base_sha256, coalesce(every.r, '') AS spans
FROM docs LEFT JOIN b USING (rid) LEFT JOIN every USING (rid)
"""


OP7 = f"""
WITH lines AS (SELECT rid, doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line, ('0x' || substr(md5(string_split(coalesce(text, ''), chr(10))[i]), 1, 7))::BIGINT AS h
    FROM (SELECT row_number() OVER () AS rid, doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
rolls AS (SELECT *, count(*) OVER w AS n, CASE WHEN i > 1 THEN (lag(h) OVER o * {line_dedup.BASE} + h) % {line_dedup.MODULUS} END AS roll FROM lines WINDOW w AS (PARTITION BY rid), o AS (PARTITION BY rid ORDER BY i)),
marked AS (SELECT *, i = n OR (roll IS NOT NULL AND i >= 2 AND i + 2 <= n AND coalesce(roll < lag(roll) OVER o, TRUE) AND coalesce(roll < lead(roll) OVER o, TRUE)) AS ends FROM rolls WINDOW o AS (PARTITION BY rid ORDER BY i)),
runs AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM marked),
pieces AS (SELECT *, least((row_number() OVER (PARTITION BY rid, run ORDER BY i) - 1) // 2, greatest(count(*) OVER (PARTITION BY rid, run) // 2 - 1, 0)) AS piece FROM runs),
chunks AS (SELECT rid, doc_id, run, piece, min(i) AS a, count(*) AS m, string_agg(line, chr(10) ORDER BY i) AS body FROM pieces GROUP BY ALL),
judged AS (SELECT rid, run, piece, m, m >= 2 AND row_number() OVER (PARTITION BY body, m >= 2 ORDER BY doc_id, a) > 1 AS gone FROM chunks)
SELECT doc_id, n_lines, n_removed_lines, n_removed_chunks, sha256(kept) AS kept_sha256 FROM (
    SELECT rid, any_value(p.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM pieces p JOIN judged j USING (rid, run, piece) GROUP BY rid)
    JOIN (SELECT rid, count(*) FILTER (gone) AS n_removed_chunks FROM judged GROUP BY rid) USING (rid)
"""

# All pairs of different word sequences that share a shingle, by exact multiset overlap.
OP2 = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
named AS (SELECT rid, doc_id, w, CASE WHEN len(w) = 0 THEN 'raw ' || t ELSE 'words ' || array_to_string(w, ' ') END AS c FROM docs),
classes AS (SELECT c, min(rid) AS id, any_value(w) AS w FROM named GROUP BY c),
bags AS (SELECT id, s, count(*) AS n FROM (
    SELECT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM classes WHERE len(w) > 0) GROUP BY ALL),
sizes AS (SELECT id, sum(n) AS size FROM bags GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS common FROM bags a JOIN bags b ON a.s = b.s AND a.id <> b.id GROUP BY ALL),
edges AS (SELECT a, b FROM pairs p JOIN sizes x ON p.a = x.id JOIN sizes y ON p.b = y.id WHERE common >= 0.8 * (x.size + y.size - common) - 1e-9),
reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
rows_ AS (SELECT n.doc_id, r.root, n.rid FROM named n JOIN classes k USING (c) JOIN roots r ON r.id = k.id)
SELECT doc_id, min(doc_id) OVER g AS group_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY root ORDER BY doc_id) = 1 AS kept FROM rows_ WINDOW g AS (PARTITION BY root)
"""

OP3 = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT rid, b, unnest(range(1, octet_length(b) - 198)) AS i FROM docs WHERE octet_length(b) >= 200),
wins AS (SELECT rid, i, md5(b[i : i + 199]) AS w FROM starts),
hits AS (SELECT rid, i FROM wins JOIN (SELECT w FROM wins GROUP BY w HAVING count(*) > 1) USING (w)),
runs AS (SELECT rid, i, sum((i > coalesce(prev, -1000) + 200)::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM hits)),
spans AS (SELECT rid, min(i) AS a, max(i) + 200 AS z FROM runs GROUP BY rid, run),
gaps AS (SELECT rid, z AS a, coalesce(lead(a) OVER (PARTITION BY rid ORDER BY a), 1000000000000) AS z FROM (SELECT rid, a, z FROM spans UNION ALL SELECT rid, 0, 1 FROM docs)),
kept AS (SELECT rid, coalesce(string_agg(hex(b[g.a : least(g.z, octet_length(b) + 1) - 1]), '' ORDER BY g.a) FILTER (g.a < least(g.z, octet_length(b) + 1)), '') AS h FROM gaps g JOIN docs USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM docs JOIN kept USING (rid) LEFT JOIN (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid) USING (rid)
"""

OP4 = r"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, (('0x' || substr(md5('11:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
sources AS (SELECT *, 3.0::DOUBLE * source_size AS cap, (5 - 3 * (pos % 3 >= 1)::INT - (pos % 3 = 2)::INT)::DOUBLE AS w FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS pos FROM docs GROUP BY source)),
filled AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, row_number() OVER (ORDER BY cap / w, pos) AS k FROM sources),
level AS (SELECT (total - used) / free AS level FROM filled WHERE cap > w * ((total - used) / free) ORDER BY k LIMIT 1),
goals AS (SELECT source, source_size, least(cap, w * (SELECT level FROM level)) AS target FROM filled),
parts AS (SELECT *, greatest(target - whole * source_size, 0) AS need FROM (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12)::BIGINT AS whole FROM goals)),
weighed AS (SELECT d.*, source_size, target, whole, need, length(bin(size)) AS w FROM docs d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
cells AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY w DESC) - words AS above, sum(words * w) OVER (PARTITION BY source ORDER BY w) AS mass FROM (SELECT source, w, any_value(need) AS need, sum(size) AS words FROM weighed GROUP BY ALL)),
factors AS (SELECT *, CASE WHEN mass > 0 THEN (need - above::DOUBLE) / mass::DOUBLE END AS factor FROM cells),
tops AS (SELECT source, max(w) FILTER (factor * w <= 1) AS top, arg_max(factor, w) FILTER (factor * w <= 1) AS best FROM factors GROUP BY source),
lambdas AS (SELECT f.source, f.w, CASE WHEN need <= 0 OR words = 0 THEN 0 WHEN top IS NULL OR f.w > top THEN 1 ELSE least(greatest(best, 0) * f.w, 1) END AS lam FROM factors f JOIN tops t ON f.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT x.*, lam, CASE WHEN lam <= 0 THEN 1 ELSE u * (1 - lam) / (u * (1 - lam) + (1 - u) * lam) END AS rnk FROM weighed x JOIN lambdas l ON x.source IS NOT DISTINCT FROM l.source AND x.w = l.w),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id) - size AS behind FROM ranked)
SELECT doc_id, size, source_size, target, least(whole + extra, 3) AS copies, least(whole + extra, 3) * size AS taken
FROM (SELECT *, CASE WHEN size = 0 OR lam <= 0 THEN 0 ELSE greatest(least(floor((need - behind) / size + 0.5), 1), 0)::BIGINT END AS extra FROM placed)
"""

# The contract's own columns of op8 and op10, without what the methods add.
LICENSE_PHRASES = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES ('under the mit license', 'mit'), ('apache license version 2', 'apache-2'), ('cc by nc', 'cc-by-nc')) v(p, label)),
found AS (SELECT rid, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) AS place FROM docs, phrases),
sums AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM found GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM docs LEFT JOIN sums USING (rid)
"""

RULE_COUNTS = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS n FROM wins) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, range(3) r(j) GROUP BY rid),
lines AS (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dups AS (SELECT rid, sum(n - 1)::BIGINT AS n FROM lines GROUP BY rid)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed FROM docs LEFT JOIN covered USING (rid) LEFT JOIN dups USING (rid)
"""



def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LOW = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TEMPLATES = ", ".join(f"({i}, {_text(label)}, {_text(text)})" for i, (label, text) in enumerate(license_scan.TEMPLATES))
_MARKS = ", ".join(f"({_text(m)})" for m in license_scan.MARKS)
# Three-word grams by diagonal, runs of diagonals at most two apart, each compared with its template word by word.
OP8 = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_LOW.format(t="coalesce(text, '')")} AS w FROM documents),
templates AS (SELECT tpl, label, {_LOW.format(t="t")} AS tw FROM (VALUES {_TEMPLATES}) v(tpl, label, t)),
tgrams AS (SELECT tpl, o, tw[o + 1] || ' ' || tw[o + 2] || ' ' || tw[o + 3] AS g FROM (SELECT tpl, tw, unnest(range(0, len(tw) - 2)) AS o FROM templates)),
grams AS (SELECT rid, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS g FROM (SELECT rid, w, unnest(range(0, len(w) - 2)) AS p FROM docs)),
hits AS (SELECT rid, tpl, p, o, p - o AS d FROM grams JOIN tgrams USING (g)),
runs AS (SELECT *, sum((d - prev > 2)::INT) OVER (PARTITION BY rid, tpl ORDER BY d, p ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce(lag(d) OVER (PARTITION BY rid, tpl ORDER BY d, p), d) AS prev FROM hits)),
spans AS (SELECT rid, tpl, run, min(p) AS lo, max(p) + 3 AS hi, max(o) - min(o) + 3 AS reach FROM runs GROUP BY ALL),
marks AS (SELECT m FROM (VALUES {_MARKS}) v(m)),
marked AS (SELECT tpl, coalesce(list(m ORDER BY m), []) AS ms FROM templates JOIN marks ON contains(' ' || array_to_string(tw, ' ') || ' ', ' ' || m || ' ') GROUP BY tpl),
fits AS (SELECT s.*, w, tw, label FROM spans s JOIN docs USING (rid) JOIN templates USING (tpl) LEFT JOIN marked USING (tpl)
    WHERE hi - lo <= 1.5 * reach AND coalesce(ms, []) = coalesce((SELECT list(m ORDER BY m) FROM marks WHERE contains(' ' || array_to_string(w[lo + 1 : hi], ' ') || ' ', ' ' || m || ' ')), [])),
same AS (SELECT f.rid, f.tpl, f.run, count(DISTINCT x - d) AS equal FROM (SELECT f.*, d, unnest(range(greatest(lo, d), least(hi, d + len(tw)))) AS x FROM fits f JOIN (SELECT DISTINCT rid, tpl, run, d FROM runs) USING (rid, tpl, run)) f WHERE w[x + 1] = tw[x - d + 1] GROUP BY ALL),
good AS (SELECT rid, lo, hi, equal, len(tw) AS size, label FROM fits JOIN same USING (rid, tpl, run) WHERE equal >= greatest(0.6 * len(tw), least(6, len(tw)))),
best AS (SELECT * FROM good y WHERE NOT EXISTS (SELECT 1 FROM good z WHERE z.rid = y.rid AND z.equal > y.equal AND z.lo < y.hi AND y.lo < z.hi)),
base AS ({LICENSE_PHRASES.replace("SELECT doc_id, len(w)", "SELECT rid, doc_id, len(w)")}),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM best UNION ALL SELECT rid, unnest(string_split(base_labels, ',')) FROM base WHERE base_labels <> '') GROUP BY rid)
SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score
FROM base LEFT JOIN every USING (rid) LEFT JOIN (SELECT rid, max(equal::DOUBLE / size) AS score FROM best GROUP BY rid) USING (rid)
"""

ORACLES = {
    "op2_bagminhash_dedup": OP2,
    "op3_run_length_index": OP3,
    "op4_pareto_mix": OP4,
    "op6_linked_secrets": OP6,
    "op7_line_chunks": OP7,
    "op8_license_diagonals": OP8,
    "op9_bounded_ring": OP9,
    "license_phrases": LICENSE_PHRASES,
    "rule_counts": RULE_COUNTS,
}
