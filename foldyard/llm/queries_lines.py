"""Line dedup over all documents, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_templates import drop_recurring_lines


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.col("dedup.text")
    return drop_recurring_lines(docs).select(
        "doc_id", "dedup.n_lines", "dedup.n_dropped", F.sha2(text, 256).alias("kept_sha256")
    )


WS = r"[\x20\x09-\x0D]+"
DROPS = rf"""
keyed AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT r, doc_id, unnest(str_split(t, chr(10))) AS line, unnest(range(len(str_split(t, chr(10))))) AS line_no
          FROM keyed),
lines AS (
    SELECT r, doc_id, line_no, literal, masked, toks, len(toks) || ' ' || array_to_string(toks[1:3], ' ') AS hash_key
    FROM (
        SELECT *, str_split(masked, ' ') AS toks FROM (
            SELECT *, regexp_replace(literal, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM (
                SELECT r, doc_id, line_no,
                       regexp_replace(trim(regexp_replace(line, '{WS}', ' ', 'g'), ' '), ' +', ' ', 'g') AS literal
                FROM split)))
    WHERE len(toks) >= 3
),
leaves AS (SELECT hash_key, count(DISTINCT r) AS leaf_docs FROM lines GROUP BY hash_key HAVING count(DISTINCT r) >= 8),
busy AS (SELECT * FROM lines JOIN leaves USING (hash_key)),
types AS (SELECT hash_key, leaf_docs, masked, toks, count(DISTINCT r) AS docs FROM busy GROUP BY ALL),
tokens AS (SELECT hash_key, leaf_docs, masked, docs, unnest(toks) AS token, unnest(range(len(toks))) AS pos FROM types),
support AS (SELECT hash_key, pos, token, sum(docs) AS support FROM tokens GROUP BY ALL),
fields AS (
    SELECT hash_key, masked,
           string_agg(CASE WHEN support > 0.125 * leaf_docs THEN token ELSE '<*>' END, ' ' ORDER BY pos) AS general,
           avg((support > 0.125 * leaf_docs AND token <> '<*>')::INT) AS constant_share
    FROM tokens JOIN support USING (hash_key, pos, token) GROUP BY hash_key, masked
),
forms AS (
    SELECT r, doc_id, line_no, hash_key, 8 AS least, general AS form
    FROM busy JOIN fields USING (hash_key, masked) WHERE constant_share >= 0.75
    UNION ALL
    SELECT r, doc_id, line_no, hash_key, 2 AS least, literal AS form FROM lines
),
found AS (SELECT hash_key, least, form, arg_min(r, doc_id) AS first_r FROM forms
          GROUP BY hash_key, least, form HAVING count(DISTINCT r) >= least),
drops AS (SELECT DISTINCT r, line_no FROM forms JOIN found USING (hash_key, least, form) WHERE r <> first_r)
"""
SQL = rf"""
WITH {DROPS},
kept AS (
    SELECT r, string_agg(line, chr(10) ORDER BY line_no) AS text
    FROM split LEFT JOIN drops USING (r, line_no) WHERE drops.r IS NULL GROUP BY r
)
SELECT doc_id, len(str_split(t, chr(10)))::BIGINT AS n_lines,
       (SELECT count(*) FROM drops WHERE drops.r = keyed.r)::BIGINT AS n_dropped,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM keyed LEFT JOIN kept USING (r)
"""
QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {"op4_line_dedup": SQL}
