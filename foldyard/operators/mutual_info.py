"""Binned mutual information between each feature and the target, per fold model."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order_stats import rank_thresholds

BINS = 16


def _stacked(df: DataFrame, columns: list[str], fold: str) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(i).alias("col"), F.col(c).alias("value")) for i, c in enumerate(columns)]
    )
    return df.select(fold, F.inline(pairs))


def train_bin_edges(
    df: DataFrame, columns: list[str], k: int, bins: int = BINS, fold: str = "fold"
) -> dict[tuple[int, int], list[float]]:
    """Equal-frequency edges of each (fold model, column): exact values at the ranks
    i*n/bins of the model's training rows."""
    sizes = {r[0]: r[1] for r in df.groupBy(fold).count().collect()}
    n = sum(sizes.values())
    cuts = {
        (c, m): sorted({i * (n - sizes.get(m, 0)) // bins for i in range(1, bins)})
        for m in range(k)
        for c in range(len(columns))
    }
    values = _stacked(df, columns, fold)
    found = rank_thresholds(values, ["value"], cuts, strata=["col"], leave_out=fold)
    return {(m, c): sorted({v[0] for v in at.values()}) for (c, m), at in found.items()}


def train_mutual_info(
    df: DataFrame,
    features: list[str],
    target: str,
    k: int,
    bins: int = BINS,
    fold: str = "fold",
) -> np.ndarray:
    """Mutual information (nats) per fold model and feature, shape (k, features).

    A value's bin is the number of edges below or equal to it. The contingency
    counts of all models and features come from one aggregate.
    """
    columns = [*features, target]
    edges = train_bin_edges(df, columns, k, bins, fold)

    # Cut every column at the edges of all models at once: counts of these fine cells
    # add up over folds, and each model's bins are unions of them.
    fine = [sorted({e for m in range(k) for e in edges[(m, i)]}) for i in range(len(columns))]

    inf = float("inf")
    cells = Bucketizer(
        splitsArray=[[-inf, *map(float, f), inf] for f in fine],
        inputCols=columns,
        outputCols=[f"_c{i}" for i in range(len(columns))],
    ).transform(df.select(fold, *columns))
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("feature"), F.col(f"_c{i}").cast("int").alias("fx"))
            for i in range(len(features))
        ]
    )
    counts = (
        cells.select(fold, F.col(f"_c{len(features)}").cast("int").alias("fy"), F.inline(pairs))
        .groupBy(fold, "feature", "fx", "fy")
        .agg(F.count("*").alias("n"))
    )
    # bins_at[feature][fine cell] is that cell's bin under each model.
    bins_at = [
        [
            [sum(e in fine[i][:at] for e in edges[(m, i)]) for m in range(k)]
            for at in range(len(fine[i]) + 1)
        ]
        for i in range(len(columns))
    ]
    lookup = df.sparkSession.createDataFrame(
        [(i, at, row) for i, table in enumerate(bins_at) for at, row in enumerate(table)],
        "col int, at int, bins array<int>",
    )
    # At most columns * (models * bins) rows.
    x_bins = F.broadcast(lookup.select(F.col("col").alias("feature"), F.col("at").alias("fx"), F.col("bins").alias("xb")))
    y_bins = F.broadcast(
        lookup.where(F.col("col") == len(features)).select(
            F.col("at").alias("fy"), F.col("bins").alias("yb")
        )
    )
    long = (
        counts.join(x_bins, ["feature", "fx"])
        .join(y_bins, "fy")
        .select("feature", "n", fold, F.posexplode(F.arrays_zip("xb", "yb")).alias("model", "b"))
        .where(F.col("model") != F.col(fold))
        .groupBy("model", "feature", F.col("b.xb").alias("bx"), F.col("b.yb").alias("by"))
        .agg(F.sum("n").alias("count"))
    )
    # n ln n summed over the cells, the rows, the columns and the whole of each table:
    # one row for each model and feature comes back.
    key = ["model", "feature"]
    parts = long.persist()

    def entropy_sums(name: str, *axes: str) -> DataFrame:
        sums = parts.groupBy(*key, *axes).agg(F.sum("count").cast("double").alias("n"))
        return sums.groupBy(*key).agg(F.sum(F.col("n") * F.log("n")).alias(name))

    whole = parts.groupBy(*key).agg(F.sum("count").cast("double").alias("n"))
    found = whole
    for name, axes in (("xy", ("bx", "by")), ("x", ("bx",)), ("y", ("by",))):
        found = found.join(entropy_sums(name, *axes), key)
    n = F.col("n")
    information = (F.col("xy") - F.col("x") - F.col("y") + n * F.log(n)) / n
    out = np.zeros((k, len(features)))
    for model, feature, value in found.select(*key, information).collect():
        out[model, feature] = max(0.0, value)
    parts.unpersist()
    return out
