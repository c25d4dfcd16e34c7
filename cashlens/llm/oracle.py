"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
ranked AS (
  SELECT source, s AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source)),
levels AS (
  SELECT *, sum(source_size) OVER () AS total, source_size / weight AS fill FROM ranked),
water AS (
  SELECT *, 3 * total - 4 * coalesce(sum(source_size) OVER (ORDER BY fill, source IS NULL, source
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY fill, source IS NULL, source
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM levels),
first_open AS (
  SELECT rest AS r, open_weight AS w, fill AS f FROM water
  WHERE source_size > 0 AND rest * weight <= 4 * source_size * open_weight ORDER BY fill, source IS NULL, source LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN source_size = 0 THEN 0.0
              WHEN (SELECT count(*) FROM first_open) = 0 THEN 2.0 * source_size
              WHEN (SELECT r FROM first_open) * weight <= 4 * source_size * (SELECT w FROM first_open)
              THEN ((SELECT r FROM first_open) * weight)::DOUBLE / (2.0::DOUBLE * (SELECT w FROM first_open)::DOUBLE)
              ELSE 2.0 * source_size END::DOUBLE AS target
  FROM water),
ordered AS (
  SELECT s.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
picked AS (
  SELECT *, CASE WHEN size = 0 THEN 0
                 WHEN 2 * upto - size <= 2 * (target - whole * source_size) THEN whole + 1 ELSE whole END::BIGINT AS repeats
  FROM ordered)
SELECT doc_id, source, size, source_size, target, repeats, (repeats * size)::BIGINT AS taken FROM picked
"""

OP2 = """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents),
grouped AS (SELECT body, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM folded GROUP BY body)
SELECT f.doc_id, g.keep_id, g.group_size, f.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(f.body) AS text_sha256
FROM folded f JOIN grouped g USING (body)
"""


OP4 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS id, a AS node FROM edges UNION SELECT r.id, e.b FROM reached r JOIN edges e ON e.a = r.node),
least AS (SELECT id, min(node) AS component FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, coalesce(l.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.id = d.doc_id
"""

OP7 = """
WITH RECURSIVE doubles AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
usable AS (
  SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM doubles
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
edges AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
  WHERE list_inner_product(a.u, b.u) >= 0.93),
reached AS (SELECT a AS id, a AS node FROM edges UNION SELECT r.id, e.b FROM reached r JOIN edges e ON e.a = r.node),
least AS (SELECT id, min(node) AS component FROM reached GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.component, e.vec_id) AS component_id, coalesce(l.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least l ON l.id = e.vec_id
"""

OP8 = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, CAST(NULL AS VARCHAR) AS fault
FROM firsts
"""

OP9 = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM lines),
spread AS (SELECT b FROM bare WHERE b <> '' AND source IS NOT NULL GROUP BY b HAVING count(DISTINCT source) >= 5),
marked AS (SELECT x.*, s.b IS NOT NULL AS gone FROM bare x LEFT JOIN spread s ON s.b = x.b)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') END AS text,
  count(place)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id, d.text
"""

# DuckDB has no crc32: a table of 256 entries, built bit by bit, is folded over the bytes.
_CRC_BIT = "CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
_CRC_ENTRY = "list_reduce(list_prepend(i, [1, 2, 3, 4, 5, 6, 7, 8]), lambda v, step: " + _CRC_BIT + ")"

OP11 = rf"""
WITH RECURSIVE crc AS (SELECT list({_CRC_ENTRY}::BIGINT ORDER BY i) AS t FROM range(256) r(i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00c0}}-\x{{00ff}}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h)::BIGINT, 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) % 256) + 1]))) AS mark FROM counted, crc),
words AS (
  SELECT CASE WHEN mark % 199 = 0 THEN substr(run, 1, (mark % length(run))::BIGINT) || substr(run, (mark % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
vocabulary AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
placed AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocabulary),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM placed),
holes AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM placed),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, v.word, v.n FROM shorter s JOIN vocabulary v ON v.word = s.rest
  UNION SELECT v.word, s.word, s.n FROM shorter s JOIN vocabulary v ON v.word = s.rest),
best AS (SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= 5 * v.n THEN b.other END AS form, CASE WHEN b.m >= 5 * v.n THEN b.m END AS form_n
  FROM vocabulary v LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS at FROM formed UNION SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.at AS root FROM walk w JOIN formed f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN roots USING (word)
"""

OP13 = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
cut AS (SELECT doc_id, c, substr(h, 1000 * c + 1, 1098) AS h FROM (SELECT doc_id, h, unnest(range(0, (n - 50) // 500 + 1)) AS c FROM bytes WHERE n >= 50)),
strings AS (SELECT doc_id, 500 * c + p AS p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, c, h, unnest(range(0, least(500, length(h) // 2 - 49))) AS p FROM cut)),
first_in AS (SELECT s, min(doc_id) AS first_id FROM strings GROUP BY s),
gone AS (SELECT doc_id, p FROM strings JOIN first_in USING (s) WHERE first_id < doc_id),
breaks AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone),
runs AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM breaks),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
edges AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS rest FROM edges JOIN bytes USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM bytes LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix": OP1,
        "op2_exact_dedup": OP2,
        "op4_near_dedup": OP4,
        "op7_near_vectors": OP7,
        "op8_warc": OP8,
        "op9_line_dedup": OP9,
        "op11_spelling": OP11,
        "op13_repeated_strings": OP13,
    }
