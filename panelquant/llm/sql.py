"""The operators that SQL can express, for the oracle: every pair, every string, no index."""

EMBEDDINGS = """
WITH RECURSIVE good AS (
  SELECT vec_id, v FROM (SELECT vec_id, CAST(embedding AS double[]) AS v FROM embeddings)
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS bigint) AS n_links, least(vec_id, coalesce(l.b, vec_id)) AS component_id,
       vec_id <= coalesce(l.b, vec_id) AS kept
FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""

SUFFIXES = """
WITH texts AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
sized AS (SELECT doc_id, h, CAST(length(h) // 2 AS bigint) AS n FROM texts),
blocks AS (SELECT doc_id, n, h, unnest(range(0, n - 99, 500)) AS low FROM sized WHERE n >= 100),
cuts AS (SELECT doc_id, low, least(n - 99 - low, 500) AS k, substring(h, 2 * low + 1, 1198) AS part FROM blocks),
strings AS (SELECT doc_id, low, part, unnest(range(0, k)) AS i FROM cuts),
hashed AS (SELECT doc_id, low + i AS s, md5_number(substring(part, 2 * i + 1, 200)) AS m FROM strings),
firsts AS (SELECT m, min(row(doc_id, s)) AS f FROM hashed GROUP BY m HAVING count(*) > 1),
gone AS (SELECT doc_id, s FROM hashed JOIN firsts USING (m) WHERE row(doc_id, s) <> f),
steps AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM gone),
runs AS (
  SELECT doc_id, min(s) AS low, max(s) + 100 AS high
  FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM steps) GROUP BY doc_id, run),
edges AS (SELECT doc_id, low, high FROM runs UNION ALL SELECT doc_id, n, n FROM sized),
pieces AS (
  SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low, high), 0) AS after FROM edges)
SELECT doc_id, any_value(n) AS n_bytes, CAST(sum(high - low) AS bigint) AS n_removed,
       CAST(count(*) FILTER (high > low) AS bigint) AS n_spans,
       sha256(unhex(string_agg(substring(h, 2 * after + 1, 2 * (low - after)), '' ORDER BY low, high))) AS kept_sha256
FROM pieces JOIN sized USING (doc_id) GROUP BY doc_id
"""

MINHASH = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, least(5, len(w)) AS k, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM split WHERE len(w) > 0),
bags AS (SELECT doc_id, w[i:i + k - 1] AS s, count(*) AS n FROM shingles GROUP BY 1, 2),
sizes AS (SELECT doc_id, sum(n) AS size FROM bags GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common
  FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE CAST(common AS double) / CAST(x.size + y.size - common AS double) >= CAST(0.8 AS double)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(b, doc_id)) AS class_id, doc_id <= coalesce(b, doc_id) AS kept
FROM documents LEFT JOIN least ON a = doc_id
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (1), (2), (3)) AS sizes (k) WHERE len(w) >= k),
counts AS (SELECT lang, w[i:i + k - 1] AS p, k, CAST(count(*) AS hugeint) AS f FROM grams GROUP BY 1, 2, 3),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE f >= 10),
longer AS (
  SELECT lang, p, max(f) AS held FROM (
    SELECT lang, p[1:2] AS p, f FROM often WHERE k = 3 UNION ALL SELECT lang, p[2:3], f FROM often WHERE k = 3) GROUP BY 1, 2),
cuts AS (
  SELECT c.lang, c.p, c.f AS a, s.cut, l.f AS l, r.f AS r, (1000000 * c.f * c.f) // (l.f * r.f) AS score
  FROM often c JOIN (VALUES (1), (2)) AS s (cut) ON s.cut < c.k
  JOIN often l ON l.lang = c.lang AND l.p = c.p[1:s.cut] JOIN often r ON r.lang = c.lang AND r.p = c.p[s.cut + 1:]
  LEFT JOIN longer h ON h.lang = c.lang AND h.p = c.p WHERE h.held IS NULL OR 100 * h.held < 50 * c.f),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank FROM lowest)
SELECT lang, rank, phrase, CAST(a AS bigint) AS a, CAST(l AS bigint) AS l, CAST(r AS bigint) AS r,
       CAST(n AS bigint) AS n, CAST(score AS bigint) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

#: The other operators fit models, follow a hash, or match with errors; the tests compare them with plain versions.
SQL: dict[str, str] = {
    "op5_embedding_neardup": EMBEDDINGS,
    "op7_suffix_dedup": SUFFIXES,
    "op10_bag_minhash": MINHASH,
    "op11_collocations": COLLOCATIONS,
}
