"""SQL for DuckDB with the rows of the numbered queries, where SQL can express them."""

DECONTAMINATE = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), size AS (SELECT DISTINCT n FROM item_window), doc_window AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM cut, size WHERE len(w) >= n)
), hit AS (SELECT doc_id, d.n, i, item_id FROM doc_window d JOIN item_window b ON d.n = b.n AND d.s = b.s),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut LEFT JOIN place USING (doc_id) LEFT JOIN named USING (doc_id)
"""

MINHASH = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM cut WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM cut UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN size USING (doc_id)
"""

EMBEDDINGS = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding[:]::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id)
"""

SEARCH = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), asked AS (SELECT i, item_id, term, count(*) AS repeats FROM (SELECT i, item_id, unnest(w) AS term FROM item) GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc WHERE len(w) > 0),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
impact AS (
  SELECT d, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(w) * n_docs) // n_terms)) AS x
  FROM tf JOIN doc USING (d), total
), scored AS (
  SELECT i, item_id, d, doc_id, CAST(sum(repeats * w * x) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN impact USING (term) GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

SPELLING = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS crc_table FROM bits WHERE k = 8),
run AS (
  SELECT doc_id, w, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents)
  WHERE length(w) >= 7 GROUP BY ALL
), coded AS (
  SELECT w, times, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [195, ord(x) - 64] END)) AS b FROM run
), hashed AS (
  SELECT w, times, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM coded, crc
), changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, times FROM hashed
), word AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
place AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word),
cut AS (SELECT word, i, left(word, i - 1) AS l, substr(word, i + 1) AS r FROM place),
near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT cut.word, word.word FROM cut JOIN word ON word.word = cut.l || cut.r
  UNION SELECT word.word, cut.word FROM cut JOIN word ON word.word = cut.l || cut.r
), best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS b, max(n) AS m FROM near JOIN word ON word.word = b GROUP BY a
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN b END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM word LEFT JOIN best USING (word)
), led AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT led.word, formed.form FROM led JOIN formed ON formed.word = led.root WHERE formed.form IS NOT NULL
)
SELECT formed.*, root FROM formed JOIN led USING (word) WHERE root IN (SELECT word FROM formed WHERE form IS NULL)
"""
