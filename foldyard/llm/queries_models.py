"""Trained models and tokenizers over all documents (no SQL counterpart)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import factor_machine, piece_viterbi
from .maxent_lm import train_and_score

#: Where this box keeps the public vocabulary; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(_documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.encode(_documents(spark, sf_dir), PIECES)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    machine = factor_machine.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return factor_machine.score(docs, machine)


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_classifier": op3_quality_classifier,
}
ORACLES: dict[str, str] = {}
