"""SQL twins of the corpus queries whose whole result SQL can say: near-duplicates and repeated byte strings."""

from __future__ import annotations

#: Equal sets are one node; links join nodes by all their common shingles; a component is what the links reach.
NEAR_DUPLICATES = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS shingles
  FROM worded
), named AS MATERIALIZED (
  SELECT r, doc_id, shingles, len(shingles) AS n, CASE WHEN len(shingles) > 0 THEN md5(array_to_string(shingles, chr(10))) END AS node FROM sets
), nodes AS MATERIALIZED (
  SELECT node, any_value(n) AS n, min(doc_id) AS least, any_value(shingles) AS shingles FROM named WHERE node IS NOT NULL GROUP BY node
), runs AS MATERIALIZED (
  SELECT node, n, unnest(shingles) AS s FROM nodes
), common AS (
  SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM runs a JOIN runs b ON a.s = b.s AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2, 3, 4
), pairs AS MATERIALIZED (
  SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)
), links AS MATERIALIZED (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(a, b) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), components AS (
  SELECT reach.a AS node, min(nodes.least) AS least FROM reach JOIN nodes ON nodes.node = reach.b GROUP BY 1
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(doc_id = coalesce(least, doc_id), false) AS kept
FROM named LEFT JOIN components USING (node)
"""

#: Texts as hexadecimal bytes, cut into blocks of 400 starts so that no window is sought from the start of its text.
REPEATED_BYTES = """
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h, length(hex(coalesce(text, ''))) // 2 AS n FROM documents
), blocks AS (
  SELECT r, k, h[k * 800 + 1:k * 800 + 1598] AS h FROM (SELECT r, h, unnest(range(0, n // 400 + 1)) AS k FROM texts WHERE n >= 400)
), windows AS MATERIALIZED (
  SELECT r, k * 400 + j AS start, md5_number(h[j * 2 + 1:j * 2 + 800]) AS w
  FROM (SELECT r, k, h, unnest(range(0, length(h) // 2 - 399)) AS j FROM blocks WHERE length(h) >= 800)
), repeated AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), starts AS (
  SELECT r, start FROM windows SEMI JOIN repeated USING (w)
), edges AS (
  SELECT r, start, CASE WHEN start <= lag(start) OVER (PARTITION BY r ORDER BY start) + 400 THEN 0 ELSE 1 END AS fresh FROM starts
), numbered AS (
  SELECT r, start, sum(fresh) OVER (PARTITION BY r ORDER BY start) AS run FROM edges
), removed AS (
  SELECT r, run, min(start) AS low, max(start) + 400 AS high FROM numbered GROUP BY r, run
), gaps AS (
  SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS after FROM removed
), kept AS (
  SELECT r, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last, string_agg(h[after * 2 + 1:low * 2], '' ORDER BY low) AS pieces
  FROM gaps JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(pieces, '') || h[coalesce(last, 0) * 2 + 1:])) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""

#: crc32 by its table of 256 steps; deletions of words meet deletions at the same place, and whole words.
SPELLINGS = r"""
WITH RECURSIVE steps AS MATERIALIZED (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), counted AS MATERIALIZED (
  SELECT id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY 1, 2
), coded AS (
  SELECT run, n, list_transform(range(1, length(id || ':' || run) + 1), lambda i: CAST(unicode((id || ':' || run)[i]) AS BIGINT)) AS points FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [195, p - 64] END)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM coded, steps
), results AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2
), deletions AS MATERIALIZED (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS other_n FROM deletions a JOIN deletions b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM deletions d JOIN words w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM deletions d JOIN words w ON d.rest = w.word
), near AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM pairs GROUP BY 1
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
  FROM words LEFT JOIN near USING (word)
), chain(word, root, depth) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT chain.word, formed.form, depth + 1 FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM formed JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY 1) USING (word)
"""
