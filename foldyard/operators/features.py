"""Feature steps fitted on training moments: scaling, selection, PCA.

Every step here is affine, ``z = x @ weights + offset``; a chain of them is again one
such map, so a whole prefix costs one projection over the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ModelExecutionError
from .moments import Moments


@dataclass(frozen=True)
class Affine:
    """``z = x @ weights + offset``."""

    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def identity(cls, d: int) -> "Affine":
        return cls(np.eye(d), np.zeros(d))

    @classmethod
    def centred(cls, centre: np.ndarray, weights: np.ndarray) -> "Affine":
        """``(x - centre) @ weights``."""
        return cls(weights, -(centre @ weights))

    def then(self, step: "Affine") -> "Affine":
        return Affine(self.weights @ step.weights, self.offset @ step.weights + step.offset)

    @property
    def is_identity(self) -> bool:
        d, c = self.weights.shape
        return d == c and not self.offset.any() and np.array_equal(self.weights, np.eye(d))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.offset

    def columns(self, features: list[Column]) -> list[Column]:
        """The map as column expressions."""
        outputs = []
        for weights, offset in zip(self.weights.T, self.offset):
            terms = [
                f if w == 1.0 else f * F.lit(float(w))
                for f, w in zip(features, weights)
                if w != 0.0
            ]
            if offset or not terms:
                terms.append(F.lit(float(offset)))
            outputs.append(sum(terms[1:], terms[0]))
        return outputs


def own_fold_columns(chain: list[Affine], features: list[str], fold: str = "fold") -> list[Column]:
    """The maps as column expressions, each row through the map of its own fold."""

    def pick(values) -> Column:
        if len({float(v) for v in values}) == 1:
            return F.lit(float(values[0]))
        return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col(fold))

    outputs = []
    for j in range(chain[0].weights.shape[1]):
        total = pick([c.offset[j] for c in chain])
        for i, name in enumerate(features):
            weights = [c.weights[i, j] for c in chain]
            if any(weights):
                total = total + F.col(name) * pick(weights)
        outputs.append(total)
    return outputs


def take(keep: np.ndarray, d: int) -> Affine:
    """Selection of the given columns."""
    return Affine(np.eye(d)[:, keep], np.zeros(len(keep)))


def standardise(m: Moments, with_mean: bool = True, with_std: bool = True) -> Affine:
    """To zero mean and unit population variance."""
    d = len(m.x_mean)
    spread = np.sqrt(np.diag(m.xx) / m.n) if with_std else np.ones(d)
    # A column that only varies by rounding counts as constant.
    constant = spread <= 10 * np.finfo(float).eps * np.abs(m.x_mean)
    spread = np.where(constant | (spread == 0), 1.0, spread)
    centre = m.x_mean if with_mean else np.zeros(d)
    return Affine.centred(centre, np.diag(1 / spread))


def row_norm(features: list[Column], norm: str = "l2") -> list[Column]:
    """Each feature divided by the row's norm; an all-zero row stays as it is."""
    if norm == "l2":
        length = F.sqrt(sum((f * f for f in features), F.lit(0.0)))
    elif norm == "l1":
        length = sum((F.abs(f) for f in features), F.lit(0.0))
    elif norm == "max":
        sizes = [F.abs(f) for f in features]
        length = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    else:
        raise ModelExecutionError(f"norm must be l1, l2 or max, not {norm!r}")
    return [f / F.when(length == 0, 1.0).otherwise(length) for f in features]


def f_scores_regression(m: Moments) -> np.ndarray:
    """Univariate F statistic of each feature against the target."""
    sxx, freedom = np.diag(m.xx), m.n - 2
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.clip(m.xy**2 / (sxx * m.yy), 0, 1)
        return r2 / (1 - r2) * freedom


def f_scores_classes(total: Moments, class_n: np.ndarray, class_sums: np.ndarray) -> np.ndarray:
    """One-way ANOVA F; ``class_sums`` holds sums of features centred on the mean."""
    present = class_n > 0
    n, classes = total.n, int(present.sum())
    between = (class_sums[present] ** 2 / class_n[present][:, None]).sum(axis=0)
    within = np.diag(total.xx) - between
    with np.errstate(divide="ignore", invalid="ignore"):
        return (between / (classes - 1)) / (within / (n - classes))


def keep_percentile(scores: np.ndarray, percentile: float = 10) -> np.ndarray:
    """Indices of the features in the top ``percentile`` percent, in feature order.

    Scores above the cut are kept; scores equal to it fill up to the exact share,
    earliest features first.
    """
    if not 0 <= percentile <= 100:
        raise ModelExecutionError(f"percentile={percentile} must be in 0..100")
    if percentile == 100:
        return np.arange(len(scores))
    if percentile == 0:
        return np.arange(0)
    clean = np.where(np.isnan(scores), np.finfo(float).min, scores)
    cut = np.percentile(clean, 100 - percentile)
    keep = clean > cut
    room = int(len(clean) * percentile / 100) - keep.sum()
    ties = np.flatnonzero(clean == cut)
    keep[ties[: max(room, 0)]] = True
    return np.flatnonzero(keep)


def principal_axes(m: Moments, n_components=None, whiten: bool = False) -> Affine:
    """PCA; the largest loading of each axis is positive."""
    d = len(m.x_mean)
    limit = int(min(m.n, d))
    values, vectors = np.linalg.eigh(m.xx / max(m.n - 1, 1))
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    if n_components is None:
        count = limit
    elif isinstance(n_components, float) and 0 < n_components < 1:
        ratio = np.cumsum(values / values.sum())
        count = int(np.searchsorted(ratio, n_components, side="right")) + 1
    else:
        count = n_components
    if not isinstance(count, int) or not 1 <= count <= limit:
        raise ModelExecutionError(f"n_components={n_components} must be in 1..{limit}")
    axes = vectors[:, :count]
    largest = axes[np.abs(axes).argmax(axis=0), np.arange(count)]
    axes = axes * np.where(largest < 0, -1.0, 1.0)
    if whiten:
        scale = np.sqrt(values[:count])
        axes = axes / np.where(scale == 0, 1.0, scale)
    return Affine.centred(m.x_mean, axes)
