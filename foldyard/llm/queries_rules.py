"""Quality rules over all documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_rules import BOILERPLATE, NAVIGATION, SENTENCE_END, clean_lines

COLUMNS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "kept", "n_lines", "n_failed", "kept_word_chars",
)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cleaned = clean_lines(docs)
    return cleaned.select("doc_id", *(F.col(f"cleaning.{c}") for c in COLUMNS))


def _any(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


WS = r"[\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}'), lambda w: w <> '') AS ws,
           list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
    FROM documents
),
windows AS (
    SELECT r, i, list_slice(ws, i, i + 7) AS w
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)
),
found AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM windows),
covered AS (
    SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM found WHERE c > 1)
    GROUP BY r
),
lines AS (
    SELECT r, x, trim(translate(x, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') AS tight, lower(x) AS low,
           length(x) - length(replace(replace(x, '!!', '!'), '??', '?')) AS marks,
           length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS symbols,
           length(x) - length(regexp_replace(x, '[|»›•·]', '', 'g')) AS bars
    FROM (SELECT r, unnest(ls) AS x FROM d)
),
judged AS (
    SELECT r, x, len(list_filter(str_split(tight, ' '), lambda w: w <> '')) AS n, tight, low, marks, symbols, bars
    FROM lines
),
passed AS (
    SELECT r, count(*) FILTER (WHERE bad) AS n_failed,
           coalesce(sum(length(regexp_replace(x, '{WS}', '', 'g'))) FILTER (WHERE NOT bad), 0)::BIGINT AS kept_chars
    FROM (SELECT r, x,
                 (n >= 12 AND NOT contains('.!?:;…"''”’»)]。！？।۔؟։', right(tight, 1))
                          AND NOT regexp_matches(x, '{SENTENCE_END.replace("'", "''")}'))
                 OR symbols > 0.25 * n OR marks > 0.25 * n
                 OR (bars >= 2 AND bars * 5 >= n)
                 OR (n <= 6 AND {_any('low', NAVIGATION)})
                 OR (n <= 25 AND {_any('low', BOILERPLATE)}) AS bad
          FROM judged)
    GROUP BY r
),
facts AS (
    SELECT d.doc_id, len(ws)::BIGINT AS n_words,
           length(regexp_replace(t, '{WS}', '', 'g'))::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
           len(ls)::BIGINT AS n_lines, coalesce(n_failed, 0)::BIGINT AS n_failed,
           coalesce(kept_chars, 0)::BIGINT AS kept_word_chars
    FROM d LEFT JOIN covered USING (r) LEFT JOIN passed USING (r)
)
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
           AND kept_word_chars >= 0.5 * word_chars AS kept
FROM facts
"""
QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": SQL}
