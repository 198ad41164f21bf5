"""Filter interaction audit over all documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .filter_diagrams import audit_filters


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit_filters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH marks AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
),
d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
    FROM documents
),
judged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           {'A': len(ws) < 100,
            'B': 100 * len(list_distinct(ws)) < 80 * len(ws),
            'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
            'D': regexp_matches(t, '[#$%&*|]'),
            'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
    FROM d LEFT JOIN marks USING (doc_id)
),
masks AS (
    SELECT part, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END)
                 || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END)
                 || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failed,
           count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM judged GROUP BY ALL
),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM l a, l b, l c, l e, l g
    WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5
),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
marked AS (
    SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, failed, n, good, toxic,
           contains(failed, substr(filter_order, step, 1)) AS fails,
           regexp_matches(failed, '[' || substr(filter_order, 1, step - 1) || '-]') AS gone
    FROM steps, masks
),
counted AS (
    SELECT part, filter_order, step, letter,
           sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept,
           sum(n) FILTER (WHERE NOT gone AND fails) AS removed,
           sum(n) FILTER (WHERE gone AND fails) AS redundant,
           sum(n) FILTER (WHERE failed = letter) AS unique_fails,
           sum(good) FILTER (WHERE NOT gone AND fails) AS good_lost,
           sum(toxic) FILTER (WHERE NOT gone AND fails) AS toxic_lost
    FROM marked GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept,
       coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM counted
"""
QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLES = {"op11_filter_audit": SQL}
