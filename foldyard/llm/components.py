"""Connected components of a table of links, by spreading the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _digest(links: DataFrame):
    """Two sets of links with one digest are the same set, but for a 2**-128 chance."""
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi")), F.bit_xor(F.xxhash64("hi", "lo"))).first()


def stars(links: DataFrame) -> DataFrame:
    """(lo, hi): each node of ``links`` (a, b) linked to the smallest of its component.

    Each round rewrites the links: every node's neighbours are linked to the smallest
    of its neighbourhood (large star), then the same among smaller neighbours (small
    star). Links never grow in number by more than the nodes, hot nodes are combined
    before the shuffle, and rounds are about the logarithm of the longest path. Rounds
    are written to the shared folder, so a lost executor costs no earlier round.

    New links are added by ``stars(earlier stars and new links)``, which starts from
    what is known.
    """
    edges = materialize(
        links.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    )
    digest = _digest(edges)
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        smallest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        after = small.select(F.col("m").alias("lo"), "hi").union(
            small.where("lo != m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        )
        after = materialize(after.distinct())
        digest, before = _digest(after), digest
        edges = after
        if digest == before:
            return edges


def labels(edges: DataFrame) -> DataFrame:
    """node, component for each node of ``stars``."""
    nodes = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(edges.select(F.col("lo"), F.col("lo")).distinct())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of ``links`` (a, b)."""
    return labels(stars(links))
