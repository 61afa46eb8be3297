"""SQL that gives the same rows as the corpus queries that SQL can express."""

from __future__ import annotations

#: Integer inner products of all queries and rows, the twenty best of each query.
OP7 = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))::BIGINT) AS weights
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.weights, r.weights), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors r ON q.vec_id <> r.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: All windows of thirteen words with the first document of each content, and the words that later copies cover.
OP9 = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(len(words) - 12)) AS place, words FROM split WHERE len(words) >= 13
), contents AS (
  SELECT doc_id, place, array_to_string(words[place + 1 : place + 13], ' ') AS content FROM windows
), removed AS (
  SELECT doc_id, place FROM (SELECT doc_id, place, min(doc_id) OVER (PARTITION BY content) AS first FROM contents) WHERE first < doc_id
), covered AS (
  SELECT DISTINCT doc_id, place + k AS word FROM removed, range(13) AS t(k)
), each AS (
  SELECT doc_id, unnest(range(len(words))) AS word, unnest(words) AS w FROM split
), kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.w, ' ' ORDER BY e.word) AS text
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.word = c.word
  WHERE c.word IS NULL GROUP BY e.doc_id
)
SELECT s.doc_id, len(s.words) AS n_words, (len(s.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

#: Bags of five words, the weighted similarity of all documents that share one, and what the links connect.
OP2 = """
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(greatest(len(words) - 4, 1))) AS place FROM split WHERE len(words) > 0
), bags AS (
  SELECT doc_id, array_to_string(words[place + 1 : place + 5], ' ') AS shingle, count(*) AS n FROM starts GROUP BY ALL
), sizes AS (
  SELECT doc_id, sum(n) AS size FROM bags GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared
  FROM bags a JOIN bags b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared >= 0.8 * (x.size + y.size - shared) - 1e-9
  UNION
  SELECT x.doc_id, y.doc_id FROM split x JOIN split y ON x.text = y.text AND x.doc_id < y.doc_id WHERE len(x.words) = 0
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, w.b FROM reached r JOIN both_ways w ON r.b = w.a
)
SELECT a AS doc_id, min(b) AS class_id FROM reached GROUP BY a
"""

#: All strings of a hundred bytes with their first place, as hexadecimal digits, and the bytes that later ones cover.
OP10 = """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, strlen(coalesce(text, '')) AS n_bytes FROM documents
), windows AS (
  SELECT doc_id, n_bytes, unnest(range(n_bytes - 99)) AS place, digits FROM bytes WHERE n_bytes >= 100
), contents AS (
  SELECT doc_id, place, md5_number(substr(digits, 2 * place + 1, 200)) AS content FROM windows
), removed AS (
  SELECT doc_id, place FROM (SELECT doc_id, place, row_number() OVER (PARTITION BY content ORDER BY doc_id, place) AS nth FROM contents) WHERE nth > 1
), edges AS (
  SELECT doc_id, place, place > lag(place, 1, -101) OVER (PARTITION BY doc_id ORDER BY place) + 100 AS opens FROM removed
), numbered AS (
  SELECT doc_id, place, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM edges
), spans AS (
  SELECT doc_id, span, min(place) AS low, max(place) + 100 AS high FROM numbered GROUP BY 1, 2
), gaps AS (
  SELECT doc_id, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY span) AS a, low AS b FROM spans
  UNION ALL
  SELECT s.doc_id, max(high), any_value(n_bytes) FROM spans s JOIN bytes USING (doc_id) GROUP BY s.doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(digits, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS digits FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
), counted AS (
  SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT b.doc_id, b.n_bytes::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.digits, b.digits))) AS kept_sha256
FROM bytes b LEFT JOIN counted c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

#: Conversations rebuilt from their turns, a row for each first d turns of each, and sums over nodes through the smallest conversation of every node.
OP11 = """
WITH turns AS (
  SELECT conv_id, turn, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS digest, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM turns
), convs AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), parts AS (
  SELECT c.conv_id, 0 AS part, p.place, p.digest, p.size FROM convs c JOIN placed p ON p.conv_id = c.conv_id - c.conv_id % 5 AND p.place <= c.h
  UNION ALL
  SELECT c.conv_id, 1, p.place, p.digest, p.size FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h
), rebuilt AS (
  SELECT conv_id, digest, size, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM parts
), chain AS (
  SELECT conv_id, depth, size, string_agg(digest, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM chain GROUP BY node, depth
), children AS (
  SELECT left(node, length(node) - 32) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), last AS (
  SELECT conv_id, max_by(node, depth) AS node FROM chain GROUP BY conv_id
), ended AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM last GROUP BY node
), sums AS (
  SELECT a.node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens
  FROM nodes v LEFT JOIN children c ON c.node = v.node JOIN chain a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN ended e ON e.node = n.node
  LEFT JOIN nodes p ON n.depth > 0 AND p.node = left(n.node, length(n.node) - 32)
"""

ORACLES = {"op11_prefix_trie": OP11, "op2_near_duplicates": OP2, "op7_topk": OP7, "op9_substring_dedup": OP9, "op10_suffix_dedup": OP10}
