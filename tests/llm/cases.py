"""Fixtures shared by the tests of this folder: odd rows and invented prose."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD_SCHEMA = (
    "doc_id long, text string, n_words string, row int, row_key string, batch int, part int, "
    "band long, drops int, dedup int, extra string, cleaning int, edge string, task int"
)


def words(text):
    return WORDS.findall(text or "")


def prose(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["ba", "ko", "li", "mun", "ter", "sha", "o", "vi", "rel", "qua"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def odd_rows(spark, long_words: int = 30_000):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, names that
    operators might use themselves."""
    texts = [
        (1, " ".join(prose(1, 60)) + "."),
        (1, " ".join(prose(1, 60)) + "."),
        (1, " ".join(prose(2, 40)) + "."),
        (2, None),
        (3, ""),
        (4, " \n\t\r "),
        (None, " ".join(prose(3, 50)) + "."),
        (None, None),
        (5, " ".join(prose(4, long_words))),
        (6, "one"),
        (7, "naïve word Ünïcode \U0001f600 end."),
    ]
    rows = [(i, t, "x", 1, "k", 2, 3, 4, 5, 6, "e", 7, "tail", 8) for i, t in texts]
    rows[3] = (2, *[None] * 13)
    return spark.createDataFrame(rows, ODD_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
