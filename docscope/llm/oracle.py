"""DuckDB statements for the training-data queries that SQL can express.

They are plain, quadratic or regular-expression forms of the same definitions, meant
for the small tables only. Trained models, random orders, differencing and
token merges have none; the tests hold them against brute force.
"""

# One row per vector: every pair of a label compared, components by reachability.
HNSW_DEDUP = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT a AS v, b AS r FROM links
  UNION
  SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links,
  least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(c.c, e.vec_id) AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT v, min(r) AS c FROM reach GROUP BY v) c ON c.v = e.vec_id
"""

# The article element's blocks: white space first, then block tags as line ends.
HTML_EXTRACT = r"""
WITH body AS (
  SELECT page_id, url, regexp_replace(regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's'),
    '\s+', ' ', 'g') AS h FROM pages),
cut AS (
  SELECT page_id, url, string_split(regexp_replace(regexp_replace(h,
    '</?(p|h1|h2|h3|br|div|ul|ol|li|section|blockquote)( [^>]*)?/?>', chr(10), 'g'),
    '<[^>]*>', '', 'g'), chr(10)) AS lines FROM body),
clean AS (
  SELECT page_id, url, list_transform(lines, lambda x: trim(replace(replace(replace(replace(x,
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))) AS lines FROM cut)
SELECT page_id, url, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) AS text,
  CAST(length(array_to_string(list_filter(lines, lambda x: x <> ''), chr(10))) AS BIGINT) AS n_chars
FROM clean
"""

# Multisets of five-word shingles, compared through every shared shingle.
BAGMINHASH = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, s, count(*) AS c FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
      lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0)
  GROUP BY doc_id, s),
sizes AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS m
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE m / (x.n + y.n - m) >= 0.8),
reach AS (
  SELECT a AS v, b AS r FROM links
  UNION
  SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.c, d.doc_id)) AS class_id,
  d.doc_id <= coalesce(c.c, d.doc_id) AS kept, coalesce(s.n, 0) AS n_shingles
FROM documents d LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT v, min(r) AS c FROM reach GROUP BY v) c ON c.v = d.doc_id
"""

# Digests of the turns; the formatted length follows from the template, with one
# more backslash per control string and a level mark where a text has a bare one.
CHAT_FORMAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, 4 + length(role) + 2 + length(text) + 8
    + CASE WHEN regexp_matches(text, '(^|[^\\])(### |</turn>)') OR text LIKE '%\'
      THEN 2 + len(regexp_extract_all(text, '### |</turn>')) ELSE 0 END AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

# Every line keyed; lines of common keys go except from the largest document.
LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, row, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (
    SELECT doc_id, row, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (
      SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
common AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.last AS gone FROM lines l LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, row
"""
