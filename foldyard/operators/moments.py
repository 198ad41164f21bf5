"""Counts, means and co-moments per fold: one scan that serves every fold model.

The training statistics of fold model m are the merged statistics of the other
folds, so scaling, F scores, PCA, PLS and ridge for all k folds need one pass, and
linear steps before them only transform the small matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sums import fold_sums

SQL_COLUMNS = 8  # up to here co-moments are plain aggregates


@dataclass(frozen=True)
class Moments:
    """n, mean vector and centred co-moment matrix; the target is the last variable."""

    n: float
    mean: np.ndarray
    co: np.ndarray

    @staticmethod
    def merge(parts: list["Moments"]) -> "Moments":
        n = sum(p.n for p in parts)
        mean = sum(p.n * p.mean for p in parts) / n if n else parts[0].mean
        co = sum(p.co + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts)
        return Moments(n, mean, co)

    def mapped(self, weights: np.ndarray, offset: np.ndarray) -> "Moments":
        """Moments of ``z = x @ weights + offset`` with the same target."""
        d, c = weights.shape
        full = np.zeros((d + 1, c + 1))
        full[:d, :c] = weights
        full[d, c] = 1.0
        mean = self.mean @ full + np.append(offset, 0.0)
        return Moments(self.n, mean, full.T @ self.co @ full)

    @property
    def x_mean(self) -> np.ndarray:
        return self.mean[:-1]

    @property
    def y_mean(self) -> float:
        return float(self.mean[-1])

    @property
    def xx(self) -> np.ndarray:
        return self.co[:-1, :-1]

    @property
    def xy(self) -> np.ndarray:
        return self.co[:-1, -1]

    @property
    def yy(self) -> float:
        return float(self.co[-1, -1])


def train_moments(per_fold: list[Moments]) -> list[Moments]:
    """Moments of the training rows of each fold model."""
    return [
        Moments.merge([p for f, p in enumerate(per_fold) if f != m])
        for m in range(len(per_fold))
    ]


def fold_moments_columns(
    df: DataFrame, features: list[str], target: str, k: int, fold: str = "fold"
) -> list[Moments]:
    """Per-fold moments of scalar columns as one hash aggregate."""
    names = [*features, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    rows = (
        df.groupBy(fold)
        .agg(
            F.count("*").alias("n"),
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
            *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs],
        )
        .collect()
    )
    size = len(names)
    parts = [Moments(0, np.zeros(size), np.zeros((size, size))) for _ in range(k)]
    for row in rows:
        co = np.zeros((size, size))
        for i, j in pairs:
            co[i, j] = co[j, i] = row[f"c{i}_{j}"] * row["n"]
        mean = np.array([row[f"m{i}"] for i in range(size)])
        parts[row[fold]] = Moments(row["n"], mean, co)
    return parts


def gram_kernel(x, y, shift):
    """[n, sum, upper products] of the shifted columns of (X, y)."""
    v = np.column_stack([x, y]) - shift
    return np.concatenate([[len(y)], v.sum(axis=0), (v.T @ v).ravel()])


def moments_from_gram(total: np.ndarray, shift: np.ndarray) -> Moments:
    size = len(shift)
    n, sums, gram = total[0], total[1 : size + 1], total[size + 1 :].reshape(size, size)
    if not n:
        return Moments(0, np.zeros(size), np.zeros((size, size)))
    return Moments(n, shift + sums / n, gram - np.outer(sums, sums) / n)


def fold_moments_design(design: DataFrame, k: int, shift: np.ndarray) -> list[Moments]:
    """Per-fold moments of a design table; ``shift`` is any rough centre."""
    size = len(shift)
    sums = fold_sums(design, gram_kernel, [shift] * k, 1 + size + size * size, per_fold=True)
    return [moments_from_gram(s, shift) for s in sums]
