"""Line-first cleaning: lines fail on their own, then texts that lose too much go.

Native DataFrame expressions only; one pass, no shuffle. Every text is one row of work,
and inside it the repeated windows are found by sorting window hashes, so a long or very
repetitive text costs n log n.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACES, let, words

#: Phrases of page furniture; a short line holding one fails.
NAVIGATION = (
    "home page", "log in", "login", "main menu", "next page", "previous page",
    "read more", "sign in", "sign up", "skip to", "back to top", "site map",
)
#: Phrases of boilerplate; a line of a sentence or so that holds one fails.
BOILERPLATE = (
    "all rights reserved", "click here", "cookie", "javascript", "lorem ipsum",
    "privacy policy", "subscribe", "terms of use", "terms of service",
)
#: Marks that may end a line of prose, quotes and brackets included.
TERMINAL = ".!?:;…\"'”’»)]。！？।۔؟։"
#: The end of a sentence inside a line or at its end.
SENTENCE_END = r"[。！？।۔؟։]|[.!?…][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)"
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = r"[|»›•·]"
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules.

    prose_words: a line of so many words must end in a terminal mark or hold the end of
    a sentence, so prose cut off in its last sentence stays.
    symbols_per_word: more symbols a word than this fail a line.
    marks_per_word: more runs of ``!!`` or ``??`` a word than this fail a line.
    separators: so many separators, and one for each ``words_per_separator`` words at
    least, make a navigation line; so do up to ``navigation_words`` words with a phrase.
    boilerplate_words: a line of up to so many words fails by a phrase of boilerplate; a
    longer one is prose that mentions it. least_kept: share of a text's word characters in lines that stay.
    """

    prose_words: int = 12
    symbols_per_word: float = 0.25
    marks_per_word: float = 0.25
    separators: int = 2
    words_per_separator: int = 5
    navigation_words: int = 6
    boilerplate_words: int = 25
    least_kept: float = 0.5
    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8


def _has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(or_, (text.contains(p) for p in phrases))


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line (with a word) fails the punctuation, navigation or boilerplate rule."""
    facts = F.struct(
        F.regexp_count(line, F.lit(WORD)).alias("n"),
        F.lower(line).alias("low"),
        F.regexp_count(line, F.lit(SYMBOL)).alias("symbols"),
        F.regexp_count(line, F.lit(SEPARATOR)).alias("bars"),
        F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1)).alias("end"),
        line.alias("line"),
        (
            F.length(line)
            - F.length(F.replace(F.replace(line, F.lit("!!"), F.lit("!")), F.lit("??"), F.lit("?")))
        ).alias("marks"),
    )

    def judge(x: Column) -> Column:
        open_end = (x["n"] >= rules.prose_words) & ~F.lit(TERMINAL).contains(x["end"])
        unfinished = open_end & ~x["line"].rlike(SENTENCE_END)
        noisy = (x["symbols"] > rules.symbols_per_word * x["n"]) | (x["marks"] > rules.marks_per_word * x["n"])
        menu = (x["bars"] >= rules.separators) & (x["bars"] * rules.words_per_separator >= x["n"])
        phrase = (x["n"] <= rules.navigation_words) & _has_any(x["low"], NAVIGATION)
        furniture = (x["n"] <= rules.boilerplate_words) & _has_any(x["low"], BOILERPLATE)
        return unfinished | noisy | menu | phrase | furniture

    return let(facts, judge)


def _repeat_words(window: int):
    """Words in windows of ``window`` words found twice or more in the array."""

    def count(ws: Column) -> Column:
        n = F.size(ws)
        starts = F.sequence(F.lit(1), n - window + 1)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, window)))

        def covered(hs: Column) -> Column:
            tagged = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            at = let(
                tagged,
                lambda t: F.sort_array(
                    F.transform(
                        F.filter(
                            t,
                            lambda x, i: (x["h"] == F.get(t, i - 1)["h"]) | (x["h"] == F.get(t, i + 1)["h"]),
                        ),
                        lambda x: x["i"],
                    )
                ),
            )
            return let(
                at,
                lambda a: F.aggregate(
                    F.transform(a, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(a, i + 1) - p, F.lit(window)))),
                    F.lit(0),
                    lambda s, x: s + x,
                ),
            )

        repeated = let(
            hashes,
            lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)),
        )
        return F.when(n < window, F.lit(0)).otherwise(repeated).cast("long")

    return count


def clean_lines(
    df: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), prefix: str = ""
) -> DataFrame:
    """Add one struct column ``<prefix>cleaning`` to ``df``.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines
    (lines with a word), n_failed (of them), kept_word_chars, base_failed, kept, and
    text: the lines that pass, and blank ones, in order.

    Null and blank texts have zeros, fail the base rule and have the text ''. Texts and
    lines of any length are read whole; an empty table gives none. Equal
    rows get equal results, so ties need no rule; other columns, null or of any name, pass through untouched
    (a column already called ``<prefix>cleaning`` is replaced).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def solid(ws: Column) -> Column:
        return F.aggregate(ws, F.lit(0).cast("long"), lambda n, w: n + F.length(w))

    def verdict(lines: Column) -> Column:
        bodies = F.filter(lines, lambda x: x.rlike(WORD))
        passed = F.filter(lines, lambda x: ~x.rlike(WORD) | ~line_fails(x, rules))
        return let(
            F.struct(bodies.alias("b"), passed.alias("p")),
            lambda s: F.struct(
                F.size(s["b"]).cast("long").alias("n_lines"),
                (F.size(s["b"]) - F.size(F.array_distinct(s["b"]))).cast("long").alias("n_dup_lines"),
                (F.size(lines) - F.size(s["p"])).cast("long").alias("n_failed"),
                F.array_join(s["p"], "\n").alias("text"),
            ),
        )

    found = F.struct(
        let(
            words(text),
            lambda ws: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                solid(ws).alias("word_chars"),
                _repeat_words(rules.window)(ws).alias("repeats"),
            ),
        ).alias("w"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(F.split(text, "\n"), verdict).alias("v"),
    )

    def report(x: Column) -> Column:
        kept_chars = F.when(x["v"]["n_failed"] == 0, x["w"]["word_chars"]).otherwise(solid(words(x["v"]["text"])))
        failed = (x["w"]["n_words"] < rules.least_words) | (
            100 * x["w"]["repeats"] > rules.repeat_percent * x["w"]["n_words"]
        )
        return F.struct(
            x["w"]["n_words"].alias("n_words"),
            x["w"]["word_chars"].alias("word_chars"),
            x["n_symbols"].alias("n_symbols"),
            x["v"]["n_dup_lines"].alias("n_dup_lines"),
            x["w"]["repeats"].alias("n_repeat_words"),
            x["v"]["n_lines"].alias("n_lines"),
            x["v"]["n_failed"].alias("n_failed"),
            kept_chars.alias("kept_word_chars"),
            failed.alias("base_failed"),
            (~failed & (kept_chars >= rules.least_kept * x["w"]["word_chars"])).alias("kept"),
            x["v"]["text"].alias("text"),
        )

    return df.withColumn(f"{prefix}cleaning", let(found, report))
