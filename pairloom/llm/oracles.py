"""DuckDB SQL of operators whose results SQL can express, over documents."""

from __future__ import annotations


def crc_steps() -> list[int]:
    """CRC-32 of each half byte, by the rule of its reversed polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def sharding(n_shards: int = 24, whole_share: float = 0.01) -> str:
    return f"""
WITH digits AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hex, CASE WHEN text IS NULL THEN 8 ELSE octet_length(encode(text)) + 8 END AS size FROM documents),
halves AS (SELECT *, list_transform(range(1, length(hex) + 1), lambda k: instr('0123456789ABCDEF', hex[k + CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END])::BIGINT - 1) AS bits FROM digits),
own AS (SELECT doc_id, size, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h,
  xor(4294967295, list_reduce(bits, lambda c, x: xor({crc_steps()}[(xor(c, x) & 15) + 1], c >> 4), 4294967295::BIGINT)) AS crc FROM halves),
placed AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER (PARTITION BY h) AS whole, sum(size) OVER () AS total FROM own),
grouped AS (SELECT *, min(start) OVER (PARTITION BY h) AS first FROM placed),
dealt AS (SELECT *, least({n_shards - 1}, floor((CASE WHEN whole * {n_shards} <= {whole_share}::DOUBLE * total THEN 2 * first + whole ELSE 2 * start + size END) * {n_shards} / (2 * total)::DOUBLE))::INTEGER AS shard FROM grouped)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size) - 1 AS slot, NULL::INTEGER AS grown_shard FROM dealt
"""


SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM firsts WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
