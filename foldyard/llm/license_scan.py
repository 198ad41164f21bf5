"""Licence notices found by diagonal voting of word 2-grams. Native expressions only.

Every rolling word 2-gram of every text is joined to the positions it has in the notice
templates (a small fixed table, broadcast). A hit votes for the diagonal "place in the
text minus place in the template". Votes are counted per text, template and diagonal,
neighbouring diagonals are merged (a word put in or left out moves to the next one), and
a merged span is verified: all but an edit or so of the template's own 2-grams, its key
word among them, in a span not much longer than the template. Only hits are shuffled, never words or texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import keyed, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: ASCII other than letters and digits. Other alphabets are words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose every verbatim place counts, and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Openings, notice lines and clauses of public licences, their labels, and
#: the word that tells a notice from its neighbours, which must be there, beside one of the
#: notice's own words ('': none).
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", "apache"),
    ("you may not use this file except in compliance with the license", "apache-2.0", ""),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0", ""),
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ""),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", ""),
    ("licensed under the gnu general public license version 3", "gpl-3.0", "3"),
    ("licensed under the gnu general public license version 2", "gpl-2.0", "2"),
    ("licensed under the gnu lesser general public license", "lgpl", "lesser"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", ""),
    ("redistribution and use in source and binary forms with or without modification", "bsd", ""),
    ("this software is provided by the copyright holders and contributors as is", "bsd", ""),
    ("subject to the terms of the mozilla public license", "mpl", "mozilla"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "sa"),
    ("cc by nc", "cc-by-nc", ""),
    ("cc by sa", "cc-by-sa", ""),
    ("cc by nd", "cc-by-nd", ""),
    ("licensed under a creative commons attribution", "creative-commons", "creative"),
)


@dataclass(frozen=True)
class Template:
    text: str
    label: str
    exact: bool
    key: str = ""


TEMPLATES = tuple(
    [Template(t, label, True) for t, label in PHRASES] + [Template(t, label, False, key) for t, label, key in NOTICES]
)


@dataclass(frozen=True)
class ScanLimits:
    """near: diagonals so close merge. An edited word costs two 2-grams: a template of
    ``edit_size`` 2-grams or more may lack two, and any may lack a share of ``most_missing``.
    most_stretch: words in the span for each word of the template at most."""

    near: int = 2
    edit_size: int = 5
    most_missing: float = 0.25
    most_stretch: float = 1.5


def license_words(text: Column) -> Column:
    """Words with A-Z lowered. Two other letters have ASCII lower forms and must keep them."""
    text = F.coalesce(text, F.lit(""))
    odd = text.contains("\u0130") | text.contains("\u212a")
    lowered = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(lowered, BREAK), lambda w: w != "")


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row for each 2-gram of each template: a table as small as the templates."""
    rows = []
    for k, t in enumerate(templates):
        ws = t.text.split()
        rows += [(k, i, f"{a} {b}", len(ws) - 1, t.label, t.exact, t.key in ("", a, b)) for i, (a, b) in enumerate(zip(ws, ws[1:]))]
    table = spark.createDataFrame(rows, "template int, t_pos int, t_gram string, size int, label string, exact boolean, has_key boolean")
    return table.withColumn("t_hash", F.xxhash64("t_gram"))


def find_spans(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    limits: ScanLimits = ScanLimits(),
) -> DataFrame:
    """Verified spans: row_key, doc_id, template, label, exact, first_word, end_word, share.

    Phrases (``exact``) need all their 2-grams on one diagonal, which is a verbatim
    place; each diagonal is a span. Other templates merge neighbouring diagonals. Null
    and empty texts have no spans; equal rows share a ``row_key`` and have one set of
    spans; null ids and extra columns do no harm.
    """
    keys = keyed(df, id_col, text_col)
    ws = license_words(F.col("text"))
    pairs = let(
        ws,
        lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)),
    )
    grams = F.filter(pairs, lambda g: g.isNotNull())
    rolling = keys.select("row_key", "doc_id", F.posexplode(grams).alias("pos", "gram")).withColumn(
        "hash", F.xxhash64("gram")
    )
    table = template_grams(df.sparkSession, templates)
    hits = rolling.join(
        F.broadcast(table), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram"))
    )
    place = ["row_key", "doc_id", "template", "label", "exact", "size"]
    voted = (
        hits.groupBy(*place, (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .agg(
            F.collect_set("t_pos").alias("seen"),
            F.bool_or("has_key").alias("has_key"),
            F.min("pos").alias("first_word"),
            (F.max("pos") + 2).alias("end_word"),
        )
    )
    order = Window.partitionBy("row_key", "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > limits.near)
    runs = voted.withColumn("breaks", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("breaks").over(order)
    )
    merged = runs.groupBy(*place, "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("votes"),
        F.bool_or("has_key").alias("has_key"),
        F.min("first_word").alias("first_word"),
        F.max("end_word").alias("end_word"),
    )
    share = F.col("votes") / F.col("size")
    edit = F.when(F.col("size") >= limits.edit_size, 2).otherwise(0)
    missing = F.when(F.col("exact"), 0).otherwise(F.greatest(edit, F.floor(F.col("size") * limits.most_missing)))
    long = limits.most_stretch * (F.col("size") + 1)
    return merged.withColumn("share", share).where(
        F.col("has_key") & (F.col("votes") >= F.col("size") - missing) & (F.col("end_word") - F.col("first_word") <= long)
    )


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    limits: ScanLimits = ScanLimits(),
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, n_spans, score (share of the best span, 0 without one).

    Null and empty texts give zero words, null places, empty labels and score 0. Equal
    rows, and rows tied by id, get their own text's result; a text of any length is read
    whole; an empty table gives no rows; other columns, of any name, are not read.
    """
    per_row = find_spans(df, id_col, text_col, templates, limits).groupBy("row_key").agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.count("*").alias("n_spans"),
        F.max("share").alias("score"),
    )
    slim = keyed(df, id_col, text_col).select(
        "row_key", "doc_id", F.size(license_words(F.col("text"))).cast("long").alias("n_words")
    )
    return slim.join(per_row, "row_key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
