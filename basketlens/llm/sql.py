"""DuckDB statements for the queries that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

# Classes of documents with equal shingles keep the pairs few; links are counted between classes.
OP1 = f"""WITH RECURSIVE
w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text,''),'{UPPER}','{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<5 THEN [array_to_string(w,' ')]
  ELSE list_distinct([array_to_string(w[i:i+4],' ') FOR i IN range(1, len(w)-3)]) END AS s FROM w),
k AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s),
c AS (SELECT k, min(doc_id) AS id, any_value(s) AS s, any_value(n) AS n FROM k WHERE n>0 GROUP BY k),
f AS (SELECT id, n, unnest(s) AS x FROM c),
l AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON a.x=b.x AND a.id<>b.id GROUP BY a.id, b.id
  HAVING 100*count(*) >= 80*(any_value(a.n)+any_value(b.n)-count(*))),
r(a, b) AS (SELECT id, id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b=l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(m.m, k.doc_id) AS component_id
FROM k LEFT JOIN c USING (k) LEFT JOIN m ON m.a=c.id"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {1 + 10 * g}, 10))::BIGINT >> {35 - 5 * d}) & 31 AS INT) + 1, 1)"
    for g in range(4) for d in range(8))
OP5 = f"""WITH p AS (SELECT page_id, coalesce(html,'') AS x FROM pages),
h AS (SELECT page_id, sha1(x) AS h, CAST(strlen(x) AS BIGINT) AS n, max(page_id) OVER (PARTITION BY x) AS best FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id=best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id<>best THEN best END AS refers_to FROM h"""

OP6 = """WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)])=0 AND len([x FOR x IN e IF x<>0])>0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id<>b.vec_id AND list_cosine_similarity(a.e, b.e)>=0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b=l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, m.m AS component_id, vec_id=m.m AS kept FROM v JOIN m ON m.a=vec_id LEFT JOIN n ON n.a=vec_id"""

_ENDS = r"""(\.|!|\?|…|:|;|。|！|？|"|''|”|’|»|\)|\])$"""
_BOILER = "|".join(("all rights reserved", "licensed under", "released under", "creative commons", "terms of use", "terms of service",
                    "privacy policy", "cookie", "javascript", "click here", "subscribe to", "sign up", "log in", "share this",
                    "powered by", "skip to content", "copyright ©", "lorem ipsum"))
_CHARS = r"length(regexp_replace({}, '[\x20\x09-\x0D]', '', 'g'))"
OP9 = f"""WITH d AS (SELECT doc_id, coalesce(text,'') AS t, {WORDS.format("coalesce(text,'')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
y AS (SELECT doc_id, line, i, {WORDS.format('line')} AS w FROM x),
z AS (SELECT doc_id, {_CHARS.format('line')} AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i)>1 AS dup,
    NOT regexp_matches(w[-1], '{_ENDS}')
    OR (len(w)>=4 AND 2*len([v FOR v IN w IF regexp_matches(v, '[!#*$%&|<>]$')])>len(w))
    OR len([v FOR v IN w IF v IN ('|','»','›','·','•','/','>')])>=3
    OR (len(w)<=30 AND regexp_matches(translate(line,'{UPPER}','{LOWER}'), '{_BOILER}')) AS bad
  FROM y WHERE len(w)>0),
q AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(chars) FILTER (bad), 0) AS lost_chars FROM z GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, v AS v1, lead(v) OVER o AS v2, lead(v, 2) OVER o AS v3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v1, v2, v3)>1 AS again FROM g WHERE v3 IS NOT NULL),
e AS (SELECT doc_id, count(DISTINCT i+k) AS n FROM c, (VALUES (0), (1), (2)) AS t(k) WHERE again GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({_CHARS.format('t')} AS BIGINT) AS word_chars,
  CAST(length(t)-length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(q.n_dup_lines,0) AS BIGINT) AS n_dup_lines, CAST(coalesce(e.n,0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(q.lost_chars,0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN q USING (doc_id) LEFT JOIN e USING (doc_id)),
f AS (SELECT *, n_words<50 OR 100*n_repeat_words>50*n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 100*lost_chars<=50*word_chars AS kept FROM f"""

# crc32 of a text's UTF-8 bytes, by its table; ``t`` is the table's column in scope.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i,0,0,0,0,0,0,0,0],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""
_CRC = """xor(4294967295, list_reduce([4294967295] || [('0x' || substr(hex(encode({0})), 2*k+1, 2))::BIGINT FOR k IN range(strlen({0}))],
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""
_FEATURES = rf"regexp_extract_all(translate(coalesce(text,''),'{UPPER}','{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11 = f"""WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS w FROM documents),
f AS (SELECT r, unnest(w) AS w FROM d), g AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
v AS (SELECT w, {_CRC.format('w')} % 10000 AS b FROM (SELECT w FROM f UNION SELECT w FROM g), crc),
s AS (SELECT b, count(*) AS n FROM f JOIN v USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM g JOIN v USING (w) GROUP BY b),
z AS (SELECT (SELECT coalesce(sum(n),0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n),0) FROM t)::DOUBLE AS t),
gain AS (SELECT i AS b, floor(1000*ln(((coalesce(t.n,0)+1)::DOUBLE*(z.s+10000))/((coalesce(s.n,0)+1)::DOUBLE*(z.t+10000))))::BIGINT AS gain
  FROM range(10000) i(i) CROSS JOIN z LEFT JOIN s ON s.b=i LEFT JOIN t ON t.b=i),
o AS (SELECT r, sum(gain)::BIGINT AS weight FROM f JOIN v USING (w) JOIN gain USING (b) GROUP BY r),
e AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight,0) AS weight, coalesce(weight,0) +
    floor(-1000*ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR,'')),1,8))::BIGINT+0.5::DOUBLE)/4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN o USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n*10//100 THEN rank END AS rank FROM e LEFT JOIN k USING (r)"""


def _edit(rest: str, cost: str, initial: str, piece: str = "''") -> str:
    """Prepends an edit to ``rest``: nine digits of cost, audit, chr(1), repaired lines, each behind a line feed.
    The least of such texts is the cheapest, then the least audit."""
    return (f"lpad(CAST(substr({rest},1,9)::INT + {cost} AS VARCHAR), 9, '0') || '{initial}' || substr({rest}, 10, instr({rest}, chr(1)) - 9)"
            f" || {piece} || substr({rest}, instr({rest}, chr(1)) + 1)")


_KEEP = lambda rest: _edit(rest, "t", "K", "chr(10) || role || ':' || text")
_ROLE = lambda rest, role: _edit(rest, "2+t", "R", f"chr(10) || '{role}:' || text")
_NEW = lambda rest, role: _edit(rest, "2", "I", f"chr(10) || '{role}:'")
_EMPTY = "'000000000' || chr(1)"
# b: before insertions; state 0 nothing yet, 1 after s, 2 after u, 3 after a; v: with insertions.
_STEP = f"""SELECT c, i, b0, b1, least(b2, {_NEW('b3', 'assistant')}) AS v2, least(b3, {_NEW('b2', 'user')}) AS v3 FROM (
  SELECT r.c, f.i, least({_edit('v0', '3', 'D')}, CASE WHEN NOT x THEN {_ROLE('v2', 'user')} END, CASE WHEN NOT x AND r0='s' THEN {_KEEP('v1')} WHEN NOT x AND r0='u' THEN {_KEEP('v2')} END) AS b0,
    least({_edit('v1', '3', 'D')}, CASE WHEN NOT x THEN {_ROLE('v2', 'user')} END, CASE WHEN NOT x AND r0='u' THEN {_KEEP('v2')} END) AS b1,
    least({_edit('v2', '3', 'D')}, CASE WHEN NOT x THEN {_ROLE('v3', 'assistant')} END, CASE WHEN NOT x AND r0='a' THEN {_KEEP('v3')} END) AS b2,
    least({_edit('v3', '3', 'D')}, CASE WHEN NOT x THEN {_ROLE('v2', 'user')} END, CASE WHEN NOT x AND r0='u' THEN {_KEEP('v2')} END) AS b3
  FROM r JOIN f ON f.c=r.c AND f.i=r.i-1)"""
_DAMAGED_KEY = "coalesce(conv_id::VARCHAR,' ') || ':' || coalesce(turn::VARCHAR,' ')"
OP13 = f"""WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role,' ') AS role, coalesce(text,' ') AS text, {_DAMAGED_KEY} AS name FROM conversations),
h AS (SELECT c, turn, CASE WHEN {_CRC.format('name')} % 20 = 4 THEN 'user' ELSE role END AS role, {_CRC.format('name')} % 20 AS d, text FROM o, crc),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM (
  SELECT c, turn, role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text,'[.!?]','','g') ELSE text END AS text, unnest(CASE d WHEN 0 THEN [] WHEN 3 THEN [1,2] ELSE [1] END) AS copy FROM h)),
g AS (SELECT *, left(role,1) AS r0, NOT regexp_matches(text,'[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i)>1 AS again,
  NOT regexp_matches(text,'[.!?][\\x20\\x09-\\x0D]*$') AS cut, lag(left(role,1)) OVER (PARTITION BY c ORDER BY i) AS before FROM n),
f AS (SELECT *, blank OR again AS x, CASE WHEN cut AND NOT blank AND NOT again THEN 1 ELSE 0 END AS t FROM g),
s AS (SELECT c, count(*) AS n, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn),0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  sum(t)::BIGINT AS truncated, count(*) FILTER (before IS NOT NULL AND before || r0 NOT IN ('su','ua','au')) AS illegal FROM f GROUP BY c),
r(c, i, v0, v1, v2, v3) AS (
  SELECT c, n+1, {_EMPTY}, '000000004II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:', '000000002I' || chr(1) || chr(10) || 'assistant:', {_EMPTY} FROM s
  UNION ALL SELECT c, i, least(b0, {_NEW('v2', 'user')}), least(b1, {_NEW('v2', 'user')}), v2, v3 FROM ({_STEP}))
SELECT conv_id, coalesce(gaps,0) AS gaps, coalesce(blank,0) AS blank, coalesce(duplicate,0) AS duplicate, coalesce(truncated,0) AS truncated, coalesce(illegal,0) AS illegal,
  coalesce(substr(v0,1,9)::BIGINT,0) AS cost, coalesce(substr(v0,10,instr(v0,chr(1))-10),'') AS audit, sha256(coalesce(substr(v0,instr(v0,chr(1))+2),'')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM o) LEFT JOIN s USING (c) LEFT JOIN (SELECT c, v0 FROM r WHERE i=1) USING (c)"""

ORACLES = {"op1_ngram_join": OP1, "op5_warc": OP5, "op6_embedding_dedup": OP6, "op9_quality_rules": OP9, "op11_importance_resampling": OP11, "op13_conversation_repair": OP13}
