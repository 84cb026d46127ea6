"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT *, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM p WHERE w IN (SELECT w FROM p GROUP BY w HAVING count(*) > 1)),
g AS (SELECT *, CASE WHEN i > lag(i) OVER o + 200 OR lag(i) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY ALL),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, any_value(h) AS h FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN kept.doc_id IS NULL THEN d.h ELSE head || substr(d.h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, md5_number(array_to_string(w[i + 1:i + 20], ' ')) AS k FROM (SELECT *, unnest(range(0, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE nth > 1),
one AS (SELECT doc_id, unnest(range(0, len(w))) AS j, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(g.j) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY one.j) FILTER (g.j IS NULL), '') AS kept FROM one LEFT JOIN gone g USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5_number(array_to_string(w[i + 1:least(i + 5, len(w))], ' ')) AS k FROM (SELECT *, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS cnt FROM s a JOIN s b ON a.k = b.k AND a.doc_id != b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE cnt >= 0.8 * (x.n + y.n - cnt)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, min(r.b) AS class_id, coalesce(any_value(links), 0)::BIGINT AS n_links
FROM r LEFT JOIN (SELECT a, count(*) AS links FROM e GROUP BY 1) l ON l.a = r.a GROUP BY r.a"""

LINES = r"""
WITH l AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
g AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, i, line, g.k IS NOT NULL AND l.doc_id != g.last AS gone FROM l LEFT JOIN g USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

VARIANTS = """
WITH RECURSIVE t AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS v FROM range(256) r(i))),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
      FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
b AS (SELECT w, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS bytes FROM r),
h AS (SELECT w, c, xor(list_reduce(bytes, lambda a, x: xor(a // 256, t[xor(a, x) % 256 + 1]), 4294967295), 4294967295) AS h FROM b, t),
v AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(c) >= 3 AND length(word) >= 5),
i AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM v),
k AS (SELECT word, n, left(word, i) || chr(1) || substr(word, i + 2) AS k FROM i),
d AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS less FROM i),
e AS (SELECT d.word AS a, d.n AS na, v.word AS b, v.n AS nb FROM d JOIN v ON v.word = d.less),
p AS (SELECT x.word AS a, y.word AS b, y.n FROM k x JOIN k y ON x.k = y.k AND x.word != y.word UNION ALL SELECT a, b, nb FROM e UNION ALL SELECT b, a, na FROM e),
g AS (SELECT a, count(*) AS n_near, (list(b ORDER BY n DESC, b))[1] AS best, max(n) AS most FROM p GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * n THEN best END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM v LEFT JOIN g ON a = word),
s(word, root) AS (SELECT word, word FROM f UNION SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON s.word = f.word JOIN f z ON z.word = s.root AND z.form IS NULL"""

SQL = {"op11_lines": LINES, "op12_variants": VARIANTS, "op3_suffixes": SUFFIXES, "op4_substrings": SUBSTRINGS, "op6_jaccard": JACCARD}
