"""DuckDB SQL that computes the same rows from the same tables, by plain comparison of everything."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

REPEATED_WORDS = rf"""
WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
  FROM words, unnest(range(1, len(w) - 48)) AS t(i)),
least AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s),
marked AS (SELECT doc_id, i FROM windows JOIN least USING (s) WHERE d < doc_id),
gone AS (SELECT DISTINCT doc_id, k FROM marked, unnest(range(i, i + 50)) AS t(k)),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, coalesce(len(ks), 0) AS n,
    CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ks, k)) END AS left_over
  FROM words LEFT JOIN lists USING (doc_id))
SELECT doc_id, len(w) AS n_words, n AS n_removed, sha256(coalesce(array_to_string(left_over, ' '), '')) AS kept_sha256
FROM kept
"""

SIMILAR_DOCUMENTS = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE s.n / (x.n + y.n - s.n) >= 0.8),
reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
classes AS (SELECT node, least(node, min(other)) AS class_id FROM reach GROUP BY node),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n, 0) AS n_links
FROM documents LEFT JOIN classes ON node = doc_id LEFT JOIN degrees ON a = doc_id
"""

_ESCAPED = r"regexp_replace({}, '([\\<\[])', '\\\1', 'g')"

CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
learned AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn)) AS loss_sha256,
  sum(length({_ESCAPED.format('text')}) + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 18
    ELSE 14 + length(regexp_replace(role, '([\\<\[\]])', '\\\1', 'g')) END)::BIGINT AS formatted_chars
FROM learned GROUP BY conv_id
"""

_NORMAL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CONTAMINATION = rf"""
WITH items AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS s
  FROM items, unnest(range(1, greatest(len(w) - 11, 2))) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
words AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM words, lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
classes AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN classes ON node = vec_id LEFT JOIN degrees ON a = vec_id
"""

REPEATED_BYTES = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
windows AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM texts, unnest(range(0, n - 49)) AS t(i) WHERE n >= 50),
least AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s),
marked AS (SELECT doc_id, i FROM windows JOIN least USING (s) WHERE d < doc_id),
gone AS (SELECT DISTINCT doc_id, k FROM marked, unnest(range(i, i + 50)) AS t(k)),
spans AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < k - 1) AS n_spans
  FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone) GROUP BY doc_id),
bytes AS (SELECT doc_id, k, substring(h, 2 * k + 1, 2) AS b FROM texts JOIN spans USING (doc_id), unnest(range(0, n)) AS t(k)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY k) AS h FROM bytes ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN t.h ELSE coalesce(k.h, '') END)) AS kept_sha256
FROM texts t LEFT JOIN spans s ON s.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
phrases AS (
  SELECT lang, s AS size, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i : i + s - 1], ' '))) AS phrase
  FROM words, unnest(range(1, 4)) AS t(s)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, size, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS left_part,
    array_to_string(string_split(phrase, ' ')[k + 1 : size], ' ') AS right_part
  FROM f, unnest(range(1, size)) AS t(k) WHERE size >= 2),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, x.f AS l, y.f AS r,
    (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f), k) AS place
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = left_part JOIN f y ON y.lang = c.lang AND y.phrase = right_part),
longer AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS phrase, max(f) AS longest
  FROM f, unnest([1, 2]) AS t(i) WHERE size = 3 GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase AND s.size = 2
  WHERE place = 1 AND (longest IS NULL OR 100 * longest < 50 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
