"""SQL for the results of those queries that SQL can state on whole tables, by plain comparison of everything."""

OP2 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
    SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
      AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(l.y, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(l.y, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN least_of l ON l.x = v.vec_id
"""

OP4 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: md5(array_to_string(ws[i:i + 2], ' ')))
                                      WHEN len(ws) > 0 THEN [md5(array_to_string(ws, ' '))] ELSE [] END) AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(sets.doc_id, coalesce(l.y, sets.doc_id)) AS component_id
FROM sets LEFT JOIN least_of l ON l.x = sets.doc_id
"""

OP5 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT doc_id, unnest(range(1, octet_length(b) + 1)) AS i FROM d),
hashed AS (
    SELECT p.doc_id, p.i, CASE WHEN p.i + 399 <= octet_length(d.b) THEN md5(d.b[p.i:p.i + 399]) END AS h FROM places p JOIN d USING (doc_id)),
again AS (SELECT h FROM hashed WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
marked AS (SELECT doc_id, i, CASE WHEN a.h IS NOT NULL THEN 1 ELSE 0 END AS g FROM hashed LEFT JOIN again a USING (h)),
gone AS (SELECT doc_id, i, max(g) OVER (PARTITION BY doc_id ORDER BY i ROWS 399 PRECEDING) AS g FROM marked),
steps AS (SELECT *, lag(g, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone),
runs AS (
    SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS run, g, i, before FROM steps),
kept AS (SELECT doc_id, run, min(i) AS a, max(i) AS z FROM runs WHERE g = 0 GROUP BY doc_id, run),
texts AS (
    SELECT k.doc_id, string_agg(hex(d.b[k.a:k.z]), '' ORDER BY k.a) AS x FROM kept k JOIN d USING (doc_id) GROUP BY k.doc_id),
counts AS (
    SELECT doc_id, sum(g) AS n_removed, sum(CASE WHEN g = 1 AND before = 0 THEN 1 ELSE 0 END) AS n_spans FROM steps GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN texts USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i FROM d),
hashed AS (
    SELECT w.doc_id, w.i, d.ws[w.i] AS word,
           CASE WHEN w.i + 49 <= len(d.ws) THEN md5(array_to_string(d.ws[w.i:w.i + 49], ' ')) END AS h FROM words w JOIN d USING (doc_id)),
least_of AS (SELECT h, min(doc_id) AS first FROM hashed WHERE h IS NOT NULL GROUP BY h),
marked AS (SELECT doc_id, i, word, CASE WHEN first < doc_id THEN 1 ELSE 0 END AS g FROM hashed LEFT JOIN least_of USING (h)),
gone AS (SELECT doc_id, i, word, max(g) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) AS g FROM marked),
kept AS (SELECT doc_id, sum(g) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (g = 0) AS x FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP12 = r"""
WITH RECURSIVE
steps AS (  -- crc32 by bytes: each byte's table entry is eight shifts of its value
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
bytes AS (
    SELECT *, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(x) - 64 AS BIGINT)] END)) AS b
    FROM counted),
hashed AS (
    SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])),
                     CAST(4294967295 AS BIGINT)) AS h FROM bytes, steps),
varied AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM varied WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.d = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (
    SELECT word, count(*) AS n_near, max(m) AS m, min(other) FILTER (m = top) AS other
    FROM (SELECT *, max(m) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * w.n THEN b.other END AS form, CASE WHEN b.m >= 5 * w.n THEN b.m END AS form_n
    FROM words w LEFT JOIN best b USING (word)),
follow(word, root, depth) AS (
    SELECT word, word, 0 FROM formed
    UNION ALL SELECT f.word, g.form, depth + 1 FROM follow f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL)
SELECT f.word, f.form, (SELECT arg_max(root, depth) FROM follow WHERE follow.word = f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near,
       CAST(f.form_n AS BIGINT) AS form_n FROM formed f
"""

OP11 = r"""
WITH t AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY doc_id, w),
len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM len),
m AS (SELECT doc_id, CAST(100 - 25 + ((25 * CAST(n AS BIGINT) * nd) // l) AS BIGINT) AS m FROM len, total),
weight AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS wt FROM tf, total GROUP BY w, nd),
q AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
score AS (
    SELECT item_id, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM q JOIN tf USING (w) JOIN weight USING (w) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
