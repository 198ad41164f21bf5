"""Clusters and nearest neighbours of all embeddings; the clusters in SQL as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .prefix_forest import search_rows
from .zone_clusters import ClusterParams, cluster_vectors


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_embeddings(spark, sf_dir)).rows


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_rows(_embeddings(spark, sf_dir), every=20, top=20)


def _rounds(params: ClusterParams) -> str:
    """One pair of tables a round: nearest centroids, then their floored means."""
    distance = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = []
    for r in range(params.rounds + 1):
        parts.append(f"""
near{r} AS MATERIALIZED (
    SELECT r, vec_id, v, cluster, distance FROM (
        SELECT r, vec_id, v, cluster, {distance}::BIGINT AS distance FROM kept, c{r})
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1
),
c{r + 1} AS MATERIALIZED (
    SELECT cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
        SELECT cluster, list(floored ORDER BY i) AS c FROM (
            SELECT cluster, i, floor(sum(x) / count(*))::BIGINT AS floored
            FROM (SELECT cluster, unnest(v) AS x, unnest(range({params.n_components})) AS i FROM near{r})
            GROUP BY cluster, i)
        GROUP BY cluster) m USING (cluster)
)""")
    return ",".join(parts)


def _clusters_sql(params: ClusterParams) -> str:
    last = params.rounds
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id,
           list_transform(embedding, lambda x: floor({params.scale} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {params.n_components}
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {params.n_components}
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{params.salt}' || vec_id)) - 1 AS cluster, v AS c FROM kept
    QUALIFY row_number() OVER (ORDER BY sha256('{params.salt}' || vec_id)) <= {params.n_clusters}
),{_rounds(params)},
sums AS (
    SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near{last} GROUP BY cluster
)
SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia,
       (SELECT sum(distance)::BIGINT FROM near{last}) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{last} JOIN sums USING (cluster) JOIN c{last} USING (cluster)
"""


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering, "op13_nearest_neighbours": op13_nearest_neighbours}
ORACLES = {"op12_centroid_clustering": _clusters_sql(ClusterParams())}
