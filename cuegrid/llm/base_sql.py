"""The part of operators 3, 4 and 5 that SQL can express: their base columns, from the whole operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.licenses import BASE_PHRASES, op3_licenses
from cuegrid.llm.pii import op5_pii
from cuegrid.llm.quality import op4_quality


def licenses_base(spark, sf_dir: str) -> DataFrame:
    """Places are -1 where there is none."""
    place = [F.coalesce(name, F.lit(-1)).alias(name) for name in ("first_word", "last_word")]
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", *place, "base_labels")


def quality_base(spark, sf_dir: str) -> DataFrame:
    return op4_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark, sf_dir: str) -> DataFrame:
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PHRASES = " ".join("WHEN " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + f" THEN '{label}'" for phrase, label in BASE_PHRASES.items())

LICENSES_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
hits AS (
  SELECT * FROM (SELECT doc_id, i - 1 AS place, CASE {_PHRASES} END AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)) WHERE label IS NOT NULL),
sums AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, coalesce(first_word, -1)::BIGINT AS first_word, coalesce(last_word, -1)::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels
FROM words w LEFT JOIN sums s ON s.doc_id = w.doc_id
"""

QUALITY_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN covered c ON c.doc_id = w.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
"""

# The patterns of the base kinds, in order.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS gaps FROM texts"
    for k, (kind, pattern) in enumerate(_PATTERNS.items())
)

PII_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}),
places AS (
  SELECT doc_id, k, kind, m[i] AS value, regexp_replace(m[i], '[^0-9]', '', 'g') AS d,
    list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0)),
kept AS (
  SELECT doc_id, k, kind, start::BIGINT AS start, (start + length(value))::BIGINT AS stop FROM places WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INT), 0) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(d)), lambda j: CASE WHEN j % 2 = 0 THEN d[length(d) - j]::INT
      ELSE (2 * d[length(d) - j]::INT) // 10 + (2 * d[length(d) - j]::INT) % 10 END)) % 10 = 0
    ELSE length(d) BETWEEN 9 AND 15 END),
sums AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card,
    count(*) FILTER (WHERE kind = 'phone') AS n_phone, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS line FROM kept GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(line, '')) AS base_sha256
FROM texts t LEFT JOIN sums s ON s.doc_id = t.doc_id
"""
