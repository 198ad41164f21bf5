"""Line dedup with a fixed-depth template tree. Native expressions only.

Tree: a line goes by its token count, then by its leading tokens, to a leaf; tokens that
hold a digit count as variable from the start. Leaves that enough documents reach are
parsed further: a token that more than a given share of the leaf's documents have at a
position is constant there, every other position is a variable field. Lines of enough
constant tokens that generalise to one template share it. A template found in enough
documents is recurring, and so is a line, digits and all, that stands literally in
several; both go from every document but the first (smallest id), so no content leaves
the corpus. The share makes one rule of leaves of any size: field values stay variable
however large the corpus grows.

All groups are counts of line types (equal masked lines of a leaf), named by a 64-bit
hash inside their leaf: a hot line is combined before each shuffle, joins back to lines
are plain equi-joins that Spark can split, and each type's text is shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .text import SPACE, keyed, let

VARIABLE = "<*>"
#: A token with a digit in it: number, date, address, version.
WITH_DIGIT = r"[^ ]*[0-9][^ ]*"


@dataclass(frozen=True)
class TreeLimits:
    """depth: leading tokens that choose a leaf. least_tokens: shorter lines stay.
    least_documents: documents that make a leaf worth parsing, and a template recurring.
    least_repeats: documents that make one and the same line recurring.
    least_support: a constant stands in more than this share of its leaf's documents.
    least_constant: share of constant tokens that a template needs; a line with fewer
    recurs only literally."""

    depth: int = 3
    least_tokens: int = 3
    least_documents: int = 8
    least_repeats: int = 2
    least_support: float = 0.125
    least_constant: float = 0.75


#: Rows of a joined table (leaves, templates; some 24 bytes each) that are broadcast at
#: most; a larger one is joined by shuffle, its hot keys dealt over this many salts.
BROADCAST_ROWS = 1_000_000
SALTS = 16


def _flat(line: Column) -> Column:
    """Tokens joined by one blank."""
    return F.trim(F.regexp_replace(line, SPACE, " "))


def masked_line(line: Column) -> Column:
    """Tokens joined by one blank, those with a digit replaced."""
    flat = _flat(line)
    odd = line.rlike(r"[0-9\x09-\x0D]|  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.regexp_replace(flat, WITH_DIGIT, VARIABLE)).otherwise(line)


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def line_table(keys: DataFrame, limits: TreeLimits) -> DataFrame:
    """row_key, doc_id, line_no, masked, literal (hash of the unmasked tokens), leaf:
    lines with enough tokens."""

    def forms(line: Column) -> Column:
        masked = masked_line(line)
        return F.struct(masked.alias("masked"), F.when(line.rlike("[0-9]"), F.xxhash64(_flat(line))).alias("literal"))

    both = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), forms)
    lines = keys.select("row_key", "doc_id", F.posexplode(both).alias("line_no", "forms")).select(
        "row_key", "doc_id", "line_no", "forms.*"
    )
    n = _blanks(F.col("masked")) + 1
    head = F.substring_index("masked", " ", limits.depth)
    literal = F.coalesce("literal", F.xxhash64("masked"))
    return lines.where(n >= limits.least_tokens).select(
        "row_key", "doc_id", "line_no", "masked", literal.alias("literal"), F.xxhash64(n, head).alias("leaf")
    )


def _join_small(rows: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the few columns of a written table of single keys."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), on, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    return salted.join(small.select("*", salts), [*on, "salt"], how).drop("salt")


def busy_lines(keys: DataFrame, limits: TreeLimits) -> DataFrame:
    """The lines of leaves that more than one document reaches, with the number of those
    documents, written once."""
    lines = line_table(keys, limits)
    leaves = materialize(
        lines.select("leaf", F.xxhash64("row_key").alias("document"))
        .distinct()
        .groupBy("leaf")
        .count()
        .where(F.col("count") >= min(limits.least_documents, limits.least_repeats))
        .select("leaf", F.col("count").alias("leaf_docs"))
    )
    return materialize(_join_small(lines, leaves, ["leaf"]).withColumn("type", F.xxhash64("masked")))


def general_templates(busy: DataFrame, limits: TreeLimits) -> DataFrame:
    """leaf, type, general: the template of each line type with enough constants, written
    once."""
    parsed = busy.where(F.col("leaf_docs") >= limits.least_documents)
    document = F.xxhash64("row_key").alias("document")
    docs = (
        parsed.select("leaf", "leaf_docs", "type", document)
        .distinct()
        .groupBy("leaf", "leaf_docs", "type")
        .agg(F.count("*").alias("docs"))
    )
    tokens = (
        parsed.select("leaf", "type", "masked")
        .distinct()
        .join(docs, ["leaf", "type"])
        .select("leaf", "leaf_docs", "type", "docs", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    )
    support = tokens.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support"))
    constant = (F.col("support") > F.col("leaf_docs") * limits.least_support) & (F.col("token") != VARIABLE)
    field = F.when(constant, F.col("token")).otherwise(VARIABLE)
    fields = (
        tokens.join(support, ["leaf", "at", "token"])
        .groupBy("leaf", "type")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", field.alias("field")))).alias("fields"),
            F.avg(constant.cast("int")).alias("constant_share"),
        )
        .where(F.col("constant_share") >= limits.least_constant)
    )
    general = F.xxhash64(F.array_join(F.transform("fields", lambda x: x["field"]), " "))
    return materialize(fields.select("leaf", "type", general.alias("general")))


def recurring_lines(keys: DataFrame, limits: TreeLimits) -> DataFrame:
    """row_key, line_no of each line to drop."""
    busy = busy_lines(keys, limits)
    templates = general_templates(busy, limits)
    parsed = _join_small(busy.drop("masked", "leaf_docs"), templates, ["leaf", "type"], "left")
    forms = F.array(
        F.struct(F.lit(True).alias("is_general"), F.col("general").alias("form")),
        F.struct(F.lit(False).alias("is_general"), F.col("literal").alias("form")),
    )
    formed = materialize(
        parsed.select("row_key", "doc_id", "line_no", "leaf", F.inline(forms)).where("form IS NOT NULL")
    )
    same = ["leaf", "is_general", "form"]
    enough = F.when(F.col("is_general"), limits.least_documents).otherwise(limits.least_repeats)
    found = (
        formed.groupBy(*same, "row_key")
        .agg(F.min("doc_id").alias("doc_id"))
        .groupBy(*same)
        .agg(F.count("*").alias("docs"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
        .where(F.col("docs") >= enough)
        .select(*same, F.col("first.row_key").alias("first_key"))
    )
    return (
        formed.join(found, same)
        .where(F.col("row_key") != F.col("first_key"))
        .select("row_key", "line_no")
        .distinct()
    )


def drop_recurring_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: TreeLimits = TreeLimits()
) -> DataFrame:
    """``df`` with one added struct column ``dedup``: n_lines, n_dropped and text, the
    lines that stay joined by a line feed.

    Of a recurring template or line all go but those of the first document: the one with
    the smallest id. Lines that only blanks tell apart are the same; texts and lines may
    have any length. An empty table gives none. Documents are distinct (id, text) rows: repeated rows count once, and each gets the
    same result. Null and empty texts lose nothing and have the text ''. Of equal ids
    the first row is the one with the smaller text hash; null ids come last. Other
    columns, null or of any name, pass through (one called ``dedup`` is replaced).
    """
    own = df.drop("dedup").select(F.struct("*").alias("row"))
    keys = keyed(own.select("row.*"), id_col, text_col)
    drops = recurring_lines(keys, limits).groupBy("row_key").agg(F.collect_set("line_no").alias("drops"))
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    key = F.struct(
        F.coalesce(F.col(f"row.{id_col}").cast("string"), F.lit("\0")).alias("d"),
        F.xxhash64(F.coalesce(F.col(f"row.{text_col}"), F.lit("\0"))).alias("h"),
    )
    joined = own.withColumn("row_key", key).join(drops, "row_key", "left")
    lines = F.split(text, "\n")

    def without_drops(ls: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drops"))
        return F.array_join(F.transform(places, lambda i: F.get(ls, i)), "\n")

    kept = F.when(F.col("drops").isNull(), text).otherwise(let(lines, without_drops))
    dedup = F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("text"),
    )
    return joined.select("row", dedup.alias("dedup")).select("row.*", "dedup")
