"""DuckDB SQL of those queries of this subpackage that SQL can express, over whole tables.

The others are held against brute force, the tokenizer's library or held-out labels in tests/llm: fingerprints (2), retrieval by BM25 (3), merging (5),
sampling (7), minimum cuts (8) and training (9) are not relational.
"""

from __future__ import annotations

from treegrain.llm.jaccard import NGRAM, THRESHOLD
from treegrain.llm.substring import WINDOW


def _crc_table() -> str:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return f"{out}::UINTEGER[]"


def _unit(shard: int) -> str:
    return f"(('0x' || substr(md5('treegrain:{shard}:' || coalesce(doc_id::VARCHAR, chr(0))), 1, 13))::BIGINT + 0.5) / 4503599627370496"


def _shard(shards: int) -> str:
    """Equal weights: the largest of the numbers that key and shard decide."""
    return f"list_position([{', '.join(_unit(k) for k in range(shards))}], greatest({', '.join(_unit(k) for k in range(shards))})) - 1"


SHARDING = f"""WITH bytes AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' '), lambda h: h <> ''), lambda h: ('0x' || h)::UINTEGER) AS b FROM documents),
rows AS (SELECT doc_id, (len(b) + 1)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::UINTEGER, b), lambda c, x: xor(({_crc_table()})[xor(c, x) % 256 + 1], c >> 8)), 4294967295::UINTEGER)::BIGINT AS text_crc32, ({_shard(8)})::INTEGER AS shard, ({_shard(9)})::INTEGER AS grown_shard FROM bytes),
placed AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || ':' || size || ':' || text_crc32), 1, 6))::INTEGER % 4096 AS bucket FROM rows)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM placed"""

_MARKS = "len(regexp_extract_all(x, '</?turn\\b'))"
CHAT = f"""WITH log AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
told AS (SELECT *, 12 + length(role) + (length(role) - length(replace(role, '\\', ''))) + (length(role) - length(replace(role, '"', ''))) + 3 + length(x) + (length(x) - length(replace(x, '\\', ''))) + {_MARKS} + 9 AS n FROM log)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM told GROUP BY conv_id"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
SUBSTRING = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS content FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
again AS (SELECT content FROM windows GROUP BY content HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM windows SEMI JOIN again USING (content)),
every AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_JOINED = " || chr(1) || ".join(f"words[i + {k}]" for k in range(NGRAM))
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < {NGRAM} THEN [array_to_string(words, chr(1))] ELSE list_distinct(list_transform(range(1, len(words) - {NGRAM - 2}), lambda i: {_JOINED})) END AS grams FROM w),
postings AS (SELECT doc_id, unnest(grams) AS gram FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM postings a JOIN postings b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y WHERE n >= {THRESHOLD} * (len(a.grams) + len(b.grams) - n) - 1e-9
  UNION SELECT a.doc_id, b.doc_id FROM sets a, sets b WHERE len(a.grams) = 0 AND len(b.grams) = 0 AND a.doc_id < b.doc_id),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT s.doc_id, (SELECT min(y) FROM reach WHERE x = s.doc_id) AS class_id, (SELECT count(*) FROM both_ways WHERE x = s.doc_id) AS n_links, count(*) OVER (PARTITION BY list_sort(grams)) AS copies FROM sets s"""

ORACLE_SQL = {"op1_rendezvous_sharding": SHARDING, "op4_chat_formatting": CHAT, "op6_substring_dedup": SUBSTRING, "op10_ngram_jaccard": JACCARD}
