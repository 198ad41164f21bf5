"""Packing into length buckets with the least padding.

A document is cut into sequences of at most ``max_tokens`` tokens, so the histogram of
sequence lengths has at most ``max_tokens`` entries whatever the corpus. Dynamic
programming over it chooses the bucket lengths that minimise padding in all. Inside a
bucket of length L sequences are numbered without a gap and every
``token_budget // L`` of them form a batch, so only a bucket's last batch is short.

Numbers come in two levels: buckets are split into shards by a hash of the row, each
shard ranks its own rows, and a running sum of the shard sizes (a small table) gives
each shard its first number. No task holds a whole bucket and no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .text import SPACE


@dataclass(frozen=True)
class PackParams:
    """max_tokens: of a sequence. buckets: bucket lengths at most. token_budget: padded
    tokens of a batch at most (no less than max_tokens). shard_rows: rows ranked in one
    shard, on average."""

    max_tokens: int = 2048
    buckets: int = 16
    token_budget: int = 16384
    shard_rows: int = 20_000

    def __post_init__(self) -> None:
        if self.max_tokens < 1 or self.buckets < 1 or self.token_budget < self.max_tokens:
            raise ValueError("need max_tokens >= 1, buckets >= 1, token_budget >= max_tokens")


def n_words(text: Column) -> Column:
    """Words between white space; null has none."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    flat = F.trim(flat)
    blanks = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(blanks + 1).cast("long")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths, rising, that minimise the padding of the histogram; at most
    ``buckets`` of them, fewer if fewer do as well. Of equal choices the first
    boundaries are the smallest.

    cost(i, j) of one bucket for the lengths i..j is ``lengths[j] * rows - tokens``;
    best[k][j] is the least cost of the first j lengths in k buckets.
    """
    m = len(lengths)
    if not m:
        return []
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    top = min(buckets, m)
    best = np.full((top + 1, m + 1), np.iinfo(np.int64).max // 4, np.int64)
    back = np.zeros((top + 1, m + 1), np.int64)
    best[0, 0] = 0
    for k in range(1, top + 1):
        for j in range(k, m + 1):
            cost = best[k - 1, :j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            best[k, j], back[k, j] = cost[i], i
    k = int(best[1:, m].argmin()) + 1
    out, j = [], m
    while k:
        out.append(int(lengths[j - 1]))
        j, k = int(back[k, j]), k - 1
    return out[::-1]


def sequences(df: DataFrame, id_col: str, length: Column, max_tokens: int) -> DataFrame:
    """doc_id, salt, piece, first_token, n_tokens: the cuts of each document."""
    cut = df.select(F.col(id_col).alias("doc_id"), length.cast("long").alias("length"), F.xxhash64("*").alias("salt"))
    pieces = F.sequence(F.lit(0), ((F.col("length") - 1) / max_tokens).cast("int"))
    return cut.where("length > 0").select("doc_id", "salt", "length", F.explode(pieces).alias("piece")).select(
        "doc_id",
        "salt",
        "piece",
        (F.col("piece").cast("long") * max_tokens).alias("first_token"),
        F.least(F.lit(max_tokens), F.col("length") - F.col("piece").cast("long") * max_tokens).alias("n_tokens"),
    )


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    params: PackParams = PackParams(),
    length: Column | None = None,
) -> DataFrame:
    """One row per sequence: doc_id, piece, first_token, n_tokens, bucket (padded
    length), batch (number inside the bucket, from 0), slot (place in the batch).

    ``length`` is the documents' token count, by default the words of ``text_col``.
    Null, empty and blank texts have no token and no sequence; an empty table packs to
    no rows. Null ids and repeated rows are packed like others, each row on its own.
    Extra columns only take part in the hash that deals rows to shards.
    """
    length = n_words(F.col(text_col)) if length is None else length
    cuts = materialize(sequences(df, id_col, length, params.max_tokens))
    histogram = cuts.groupBy("n_tokens").count().collect()  # at most max_tokens rows
    sizes = {r["n_tokens"]: r["count"] for r in histogram}
    bounds = best_boundaries(
        np.array(list(sizes), np.int64), np.array(list(sizes.values()), np.int64), params.buckets
    )
    if not bounds:
        bounds = [params.max_tokens]
    bucket = F.array_min(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("n_tokens")))
    shards = {
        b: max(1, -(-sum(c for n, c in sizes.items() if low < n <= b) // params.shard_rows))
        for low, b in zip([0, *bounds[:-1]], bounds)
    }
    count = F.element_at(F.create_map(*(F.lit(x) for kv in shards.items() for x in kv)), F.col("bucket"))
    dealt = cuts.withColumn("bucket", bucket).withColumn(
        "shard", F.pmod(F.xxhash64("salt", "piece"), count.cast("long")).cast("int")
    )
    order = Window.partitionBy("bucket", "shard").orderBy("doc_id", "salt", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    sums = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("bucket", "shard")
        .count()
        .select("bucket", "shard", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("offset"))
    )
    number = F.col("rank") + F.col("offset")
    capacity = F.floor(F.lit(params.token_budget) / F.col("bucket")).cast("long")
    return ranked.join(offsets, ["bucket", "shard"]).select(
        "doc_id",
        "piece",
        "first_token",
        "n_tokens",
        F.col("bucket").cast("long").alias("bucket"),
        F.floor(number / capacity).alias("batch"),
        (number % capacity).alias("slot"),
    )
