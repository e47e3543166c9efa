"""SQL counterparts of the queries that SQL can express on whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
low AS (SELECT t, min(doc_id) AS low FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN low USING (t) WHERE doc_id > low),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE fresh) AS n_spans FROM
  (SELECT doc_id, p, coalesce(p <> lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 1, true) AS fresh FROM gone) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256,
coalesce(n_spans, 0)::BIGINT AS n_spans FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP2 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))) END AS s FROM d),
post AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM post a JOIN post b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
part AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
class AS (SELECT s, min(doc_id) AS class_id FROM sets WHERE len(s) > 0 GROUP BY s)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, component_id, coalesce(class_id, doc_id) AS class_id,
(SELECT count(*) FROM link WHERE link.a = sets.doc_id)::BIGINT AS n_links
FROM sets JOIN part USING (doc_id) LEFT JOIN class ON sets.s = class.s"""

OP3 = f"""WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
again AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM
  (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM win) WHERE n > 1) GROUP BY doc_id),
line AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS x FROM d),
full_line AS (SELECT *, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n,
  translate(regexp_replace(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g'), '{UPPER}', '{LOWER}') AS plain FROM line
  WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM full_line GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT text) AS documents FROM d GROUP BY host),
frequent AS (SELECT host, plain, min(doc_id) AS first FROM full_line JOIN hosts USING (host) GROUP BY host, plain, documents
  HAVING count(DISTINCT text) > 100 AND count(DISTINCT text) > 0.1 * documents),
removed AS (SELECT doc_id, sum(n) AS n_removed_words, count(DISTINCT plain) AS n_removed_lines
  FROM full_line JOIN frequent USING (host, plain) WHERE doc_id > first GROUP BY doc_id),
shared AS (SELECT host, plain, min(doc_id) AS first FROM full_line GROUP BY host, plain HAVING count(DISTINCT text) > 10),
shed AS (SELECT doc_id, sum(n) AS n_shared_words, count(DISTINCT plain) AS n_shared_lines
  FROM full_line JOIN shared USING (host, plain) WHERE doc_id > first GROUP BY doc_id),
base AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words,
  coalesce(n_removed_lines, 0)::INT AS n_removed_lines, coalesce(n_shared_words, 0)::BIGINT AS n_shared_words,
  coalesce(n_shared_lines, 0)::INT AS n_shared_lines
  FROM d LEFT JOIN again USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN removed USING (doc_id) LEFT JOIN shed USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_removed_words > 0.5 * n_words OR n_words - n_removed_words < 20)) AS kept,
NOT base_failed AND NOT (n_shared_words > 0 AND (n_shared_words > 0.5 * n_words OR n_words - n_shared_words < 20)) AS kept_without_shared FROM judged"""

OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(hx, 2 * i + 1, 800)) AS t FROM (SELECT doc_id, hx, unnest(range(0, len(hx) // 2 - 399)) AS i FROM d)),
start AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM win) WHERE n > 1),
mark AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS fresh FROM start),
run AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM
  (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mark) GROUP BY doc_id, k),
part AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM run WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(b), 1000000000 FROM run GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(hx, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM part JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM run GROUP BY doc_id)
SELECT doc_id, (len(hx) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
sha256(unhex(coalesce(k, hx))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP11 = f"""WITH piece AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents),
words AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS ws FROM piece),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang),
f AS (SELECT lang, phrase, m, count(*) AS n FROM (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (
    SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS m))) GROUP BY ALL HAVING count(*) >= 10),
cand AS (SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS p FROM f WHERE m > 1),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM cand),
scored AS (SELECT c.lang, c.phrase, c.m, c.a, c.k, x.n AS l, y.n AS r, (1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[c.k + 1:], ' ')),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_pair AS (SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase, a AS outer_a FROM cand WHERE m = 3),
gone AS (SELECT DISTINCT lang, phrase FROM inner_pair JOIN cand USING (lang, phrase) WHERE 100 * outer_a >= 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score, k AS cut FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
