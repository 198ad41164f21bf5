"""Licence scan over all documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .license_scan import BREAK, LOWER, TEMPLATES, UPPER, scan_licenses


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _template_values() -> str:
    return ", ".join(
        f"({k}, '{t.text}', '{t.label}', {str(t.exact).lower()}, '{t.key}')" for k, t in enumerate(TEMPLATES)
    )


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}'),
                       lambda w: w <> '') AS ws
    FROM documents
),
t AS (SELECT k, str_split(body, ' ') AS tw, label, exact, key
      FROM (VALUES {_template_values()}) AS v(k, body, label, exact, key)),
tg AS (SELECT k, label, exact, len(tw) - 1 AS size, i - 1 AS t_pos, tw[i] || ' ' || tw[i + 1] AS gram,
           key IN ('', tw[i], tw[i + 1]) AS has_key
       FROM (SELECT *, unnest(range(1, len(tw))) AS i FROM t)),
g AS (SELECT r, i - 1 AS pos, ws[i] || ' ' || ws[i + 1] AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws))) AS i FROM d)),
hits AS (SELECT r, k, label, exact, size, has_key, pos, t_pos, pos - t_pos AS diagonal FROM g JOIN tg USING (gram)),
diagonals AS (SELECT DISTINCT r, k, exact, diagonal FROM hits),
marked AS (
    SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER w <= 2 IS NOT TRUE THEN 1 ELSE 0 END AS breaks
    FROM diagonals WINDOW w AS (PARTITION BY r, k ORDER BY diagonal)
),
runs AS (SELECT r, k, diagonal, sum(breaks) OVER (PARTITION BY r, k ORDER BY diagonal) AS run FROM marked),
merged AS (
    SELECT r, k, label, exact, size, run, count(DISTINCT t_pos) AS votes,
           count(DISTINCT t_pos) / size AS share, bool_or(has_key) AS has_key,
           min(pos) AS first_word, max(pos) + 2 AS end_word
    FROM hits JOIN runs USING (r, k, diagonal)
    GROUP BY r, k, label, exact, size, run
),
spans AS (
    SELECT * FROM merged
    WHERE has_key AND size - votes <= CASE WHEN exact THEN 0 ELSE greatest(CASE WHEN size >= 5 THEN 2 ELSE 0 END, size // 4) END
      AND end_word - first_word <= 1.5 * (size + 1)
),
per_row AS (
    SELECT r, count(*) FILTER (WHERE exact) AS n_base,
           min(first_word) FILTER (WHERE exact) AS first_word, max(first_word) FILTER (WHERE exact) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels, count(*) AS n_spans, max(share) AS score
    FROM spans GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN per_row USING (r)
"""
QUERIES = {"op9_license_scans": op9_license_scans}
ORACLES = {"op9_license_scans": SQL}
