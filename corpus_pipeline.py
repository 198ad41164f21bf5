"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept, reread from Parquet, and
returns documents with the same columns; the last returns packed sequences. ``n_chars``
follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldyard.llm.length_buckets import pack
from foldyard.llm.line_rules import clean_lines
from foldyard.llm.line_templates import TreeLimits, drop_recurring_lines
from foldyard.llm.order_minhash import drop_near_duplicates
from foldyard.llm.substring_dedup import remove_repeats
from foldyard.llm.text import quoted
from foldyard.session import materialize


#: A template takes eight documents, and so does a literal line here: at two, every copy
#: of a document would lose its lines before near_dedup can compare it whole.
LINE_LIMITS = TreeLimits(least_repeats=8)


def _boxed(docs: DataFrame) -> DataFrame:
    """What the operators read, and the rest of the row beside it, so that no column of
    the user's can have the name of one that an operator adds. Texts are held once."""
    rest = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("row"))


def _unboxed(docs: DataFrame, row: Column, text: Column) -> Column:
    """The row with a new text and its length to match, as a struct of the same columns."""
    fields = {c: text if c == "text" else row[c] for c in docs.columns}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return F.struct(*(column.alias(c) for c, column in fields.items())).alias("row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (null and blank texts among them); lines that fail a rule
    leave the others. Rows that repeat or tie are judged alike; a text of any length is
    read whole, and an empty table stays empty."""
    kept = clean_lines(_boxed(docs)).where("cleaning.kept")
    return kept.select(_unboxed(docs, F.col("row"), F.col("cleaning.text"))).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in the document of the smallest id only. Every
    row stays, null texts as ''; an empty table stays empty."""
    found = drop_recurring_lines(_boxed(docs), limits=LINE_LIMITS)
    return found.select(_unboxed(docs, F.col("row"), F.col("dedup.text"))).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of the smallest id; of
    equal rows one. Null and empty texts are one class; an empty table stays empty."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word passages that stand in two places go from both. Every row stays,
    null texts as ''; an empty table stays empty."""
    found = remove_repeats(_boxed(docs), keep_layout=True)
    return found.select(_unboxed(docs, F.col("extra.row"), F.col("kept_text"))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2,048 words in batches of 16,384, by length bucket. Null and
    blank texts have none, longer texts several; an empty table packs to no rows."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
#: Near-duplicate classes and the choice of buckets have no SQL form; tests/llm compares
#: the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
