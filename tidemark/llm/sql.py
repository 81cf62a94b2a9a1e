"""DuckDB SQL of the registered operators that SQL can express on whole tables."""

from __future__ import annotations

from tidemark.llm.repetition import BASE_PERCENT, BASE_WINDOW, BASE_WORDS, LINE_PERCENT, NGRAM_PERCENT, SYMBOL_PERCENT
from tidemark.llm.suffix_dedup import BYTES
from tidemark.llm.window_doubling import WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_TEXTS = rf"""
texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws
  FROM documents
),
words AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM texts)"""


def repetition() -> str:
    dup = "".join(f"coalesce(sum(chars) FILTER (n = {n}), 0)::BIGINT AS dup_chars_{n}, " for n in NGRAM_PERCENT)
    zero = "".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}, " for n in NGRAM_PERCENT)
    within = " AND ".join(f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in NGRAM_PERCENT.items())
    return rf"""
WITH {_TEXTS},
sizes AS (SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM words GROUP BY rid),
grams AS (
  SELECT rid, n, i, list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') AS gram
  FROM texts, (SELECT unnest({list(NGRAM_PERCENT)}) AS n), unnest(range(1, len(ws) - n + 2)) AS t(i)
),
twice AS (SELECT rid, n, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, n, gram) AS c FROM grams) WHERE c > 1),
held AS (SELECT DISTINCT rid, n, i + k AS i FROM twice, unnest(range(0, n)) AS t(k)),
dup AS (
  SELECT rid, {dup}count(*) FILTER (n = {BASE_WINDOW}) AS n_repeat_words
  FROM (SELECT held.rid, held.n, length(word) AS chars FROM held JOIN words USING (rid, i)) GROUP BY rid
),
lines AS (
  SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS nth
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts)
  WHERE regexp_matches(line, '{_WORD}')
),
later AS (
  SELECT rid, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS dup_line_chars
  FROM lines WHERE nth > 1 GROUP BY rid
),
measured AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         {zero}coalesce(dup_line_chars, 0) AS dup_line_chars
  FROM texts LEFT JOIN sizes USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN later USING (rid)
),
judged AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND {within} AND 100 * dup_line_chars <= {LINE_PERCENT} * word_chars
          AND 100 * n_symbols <= {SYMBOL_PERCENT} * n_words AS kept
FROM judged"""


def window_doubling(n: int = WORDS) -> str:
    return rf"""
WITH {_TEXTS},
windows AS (
  SELECT rid, i, list_aggregate(ws[i:i + {n - 1}], 'string_agg', ' ') AS win
  FROM texts, unnest(range(1, len(ws) - {n - 2})) AS t(i)
),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY win) AS c FROM windows) WHERE c > 1),
gone AS (SELECT DISTINCT rid, i + k AS i FROM twice, unnest(range(0, {n})) AS t(k)),
kept AS (
  SELECT words.rid, count(*) AS n_words, count(gone.i) AS n_removed,
         string_agg(word, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS rest
  FROM words LEFT JOIN gone USING (rid, i) GROUP BY words.rid
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)"""


def byte_strings(n: int = BYTES) -> str:
    """Every window of n bytes by its MD5. Texts are hexadecimal, cut in overlapping parts:
    taking a substring walks over what lies before it."""
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS hx,
         octet_length(encode(coalesce(text, ''))) AS n_bytes
  FROM documents
),
parts AS (
  SELECT rid, n_bytes, o, substring(hx, 2 * o + 1, {2 * (512 + n - 1)}) AS part
  FROM texts, unnest(range(0, n_bytes - {n - 1}, 512)) AS t(o)
),
windows AS (
  SELECT rid, o + k AS i, md5_number(substring(part, 2 * k + 1, {2 * n})) AS win
  FROM parts, unnest(range(0, least(512, n_bytes - {n - 1} - o))) AS t(k)
),
twice AS (SELECT rid, i FROM windows WHERE win IN (SELECT win FROM windows GROUP BY win HAVING count(*) > 1)),
steps AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM twice),
numbered AS (
  SELECT rid, i, sum(CASE WHEN p IS NULL OR i > p + {n} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS span FROM steps
),
spans AS (SELECT rid, min(i) AS s, max(i) + {n} AS e FROM numbered GROUP BY rid, span),
gone AS (SELECT rid, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid),
edges AS (
  SELECT rid, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS f, s AS t FROM spans
  UNION ALL SELECT rid, max(e), max(n_bytes) FROM spans JOIN texts USING (rid) GROUP BY rid
),
kept AS (
  SELECT rid, string_agg(substring(hx, (2 * f + 1)::BIGINT, (2 * (t - f))::BIGINT), '' ORDER BY f, t) AS rest
  FROM edges JOIN texts USING (rid) GROUP BY rid
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, hx))) AS kept_sha256
FROM texts LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)"""
