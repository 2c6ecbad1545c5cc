"""DuckDB SQL for the rows of the queries that SQL can express."""

# The CRC-32 of a decimal id, bit by bit.
TRIE = """
WITH cells AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS cell
), turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'mark': mark, 'size': octet_length(encode(text))} ORDER BY turn NULLS FIRST, mark) AS items
  FROM (SELECT *, sha256(length(role) || ':' || role || text) AS mark FROM turns) GROUP BY c
), heads AS (
  SELECT c, items, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT),
    lambda acc, byte: xor(acc >> 8, cell[(xor(acc, byte) & 255) + 1]), 4294967295), 4294967295) % 9 AS h
  FROM own, cells
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.items, [])[1:a.h], a.items[a.h + 1:]) AS items
  FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 5
), places AS (
  SELECT c, d, list_transform(items[1:d], lambda t: t.mark) AS path, items[d].size AS size, d = len(items) AS ending
  FROM (SELECT c, items, unnest(range(len(items) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ending), '')) AS ends_sha256
  FROM places GROUP BY path
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT path[1:a] AS path, sum((n.n IS NULL)::BIGINT) AS leaves, sum((n_convs - 1) * coalesce(size, 0)) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM nodes) LEFT JOIN children n USING (path) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs,
  coalesce(k.n, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
LEFT JOIN children k ON k.path = n.path
JOIN below b ON b.path = n.path
"""

PHRASES = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces
), sizes AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM lists GROUP BY lang
), spots AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM lists
), counts AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, words[i:i + m - 1] AS phrase FROM spots, range(1, 5) AS t(m) WHERE i + m - 1 <= len(words)
  ) GROUP BY ALL HAVING count(*) >= 30
), candidates AS (
  SELECT lang, phrase, f AS a FROM counts WHERE len(phrase) > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM (SELECT *, unnest(range(1, len(phrase))) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = c.phrase[1:k]
  JOIN counts r ON r.lang = c.lang AND r.phrase = c.phrase[k + 1:]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, phrase[i:i + m - 1] AS phrase, max(a) AS longer
  FROM candidates, range(2, 4) AS t(m), range(1, 4) AS s(i) WHERE m < len(phrase) AND i + m - 1 <= len(phrase) GROUP BY ALL
), stay AS (
  SELECT b.* FROM best b LEFT JOIN inner_phrases USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank,
  array_to_string(phrase, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM stay JOIN sizes USING (lang) QUALIFY rank <= 2000
"""

_REACH = """reach AS (
  SELECT id, id AS far FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.far
), roots AS (SELECT id, min(far) AS component_id FROM reach GROUP BY id)"""

VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), edges AS (
  SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.id <> b.id
    AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings), {_REACH}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots ON roots.id = vec_id
LEFT JOIN (SELECT a, count(DISTINCT b) AS n FROM edges GROUP BY a) ON a = vec_id
"""

TOP_K = """
WITH cells AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.id AS query_id, c.id AS vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM cells q JOIN cells c ON q.id % 50 = 0 AND c.id <> q.id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

_ESCAPES = ("replace(replace(replace(replace({0}, '\\\\', '\\\\\\\\'), '<turn>', '\\\\o'), '<turn:esc>', '\\\\s'), '</turn>', '\\\\c')")

CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), turns AS (
  SELECT *, contains(role, chr(10)) OR regexp_matches(role || chr(0) || text, '<turn>|<turn:esc>|</turn>') AS odd FROM rows
), shown AS (
  SELECT *, CASE WHEN odd
    THEN length('<turn:esc></turn>') + length(replace({_ESCAPES.format('role')}, chr(10), '\\n')) + length({_ESCAPES.format('text')})
    ELSE length('<turn></turn>') + length(role) + length(text) END + 2 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""

NEAR_TEXTS = f"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id
), edges AS (
  SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY 1, 2)
  JOIN sizes m ON m.id = a JOIN sizes n ON n.id = b WHERE 100 * shared >= 85 * (m.n + n.n - shared)
), nodes AS (SELECT DISTINCT doc_id AS id FROM documents), {_REACH}
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN roots ON roots.id = doc_id LEFT JOIN sizes ON sizes.id = doc_id
"""

# A target is a share by weight of what capped sources leave; sources are capped in the order
# of size by weight, so the first one that fits gives the level of all after it.
TARGETS = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
  FROM sources WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), fits AS (SELECT level, place FROM levels WHERE level * weight <= 3 * source_size ORDER BY place LIMIT 1)
SELECT d.doc_id, d.size, l.source_size, round(CASE WHEN f.place IS NULL OR l.place < f.place
  THEN 3.0 * l.source_size ELSE f.level * l.weight END::DOUBLE, 6) AS target
FROM docs d JOIN levels l ON l.source IS NOT DISTINCT FROM d.source LEFT JOIN fits f ON TRUE
"""
