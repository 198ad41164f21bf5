"""Words, lines and row keys shared by the native operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text (null: none), split at white space."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``documents`` with ``row_key``, which is equal only for equal rows.

    It names a row in joins even where ids are null or repeat; equal rows share a key.
    """
    docs = documents(df, id_col, text_col)
    key = F.struct(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("d"),
        F.xxhash64(F.coalesce("text", F.lit("\0"))).alias("h"),
    )
    return docs.select("*", key.alias("row_key"))


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, as an expression."""
    return "`" + name.replace("`", "``") + "`"
