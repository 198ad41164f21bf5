"""Substring dedup over all documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .substring_dedup import remove_repeats


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
    FROM documents
),
windows AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS w
            FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY w) AS c FROM windows) WHERE c > 1),
places AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
judged AS (SELECT p.r, p.p, p.word, last_value(s.i IGNORE NULLS) OVER (PARTITION BY p.r ORDER BY p.p) AS latest
           FROM places p LEFT JOIN repeated s ON p.r = s.r AND p.p = s.i),
kept AS (
    SELECT r, count(*) FILTER (WHERE latest IS NOT NULL AND p - latest < 35) AS n_removed,
           string_agg(word, ' ' ORDER BY p) FILTER (WHERE latest IS NULL OR p - latest >= 35) AS kept_text
    FROM judged GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLES = {"op10_substring_dedup": SQL}
