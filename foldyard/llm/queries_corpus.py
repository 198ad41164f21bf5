"""Packing, near-duplicate classes and fingerprints over all documents (no SQL counterpart)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .length_buckets import pack
from .order_minhash import near_duplicate_classes
from .weighted_fingerprints import compare_with_next


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_documents(spark, sf_dir))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_documents(spark, sf_dir))


QUERIES = {
    "op5_packing": op5_packing,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
}
ORACLES: dict[str, str] = {}
