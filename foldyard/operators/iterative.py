"""Iterative estimators as repeated additive passes over a design table.

Each iteration broadcasts the parameters of all fold models, adds up one small vector
per model with ``fold_sums`` and updates the parameters on the driver. Rows never leave
their tasks.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from ..errors import ModelExecutionError
from .features import Affine
from .moments import Moments, gram_kernel, moments_from_gram
from .sums import fold_sums

DEFAULT_SEED = 0
STEP_VALUES = 1 << 15  # that a kernel makes at once, so that they stay in the core's cache


class UnfinishedFit(UserWarning):
    """An estimator that reached its last iteration before its tolerance."""


def note_unfinished(name: str, done: bool) -> None:
    if not done:
        warnings.warn(f"{name} stopped at max_iter before its tolerance", UnfinishedFit, stacklevel=3)


def _steps(n: int, width: int) -> Iterator[slice]:
    rows = max(STEP_VALUES // width, 1)
    return (slice(i, i + rows) for i in range(0, n, rows))


# -- independent components (Hyvarinen 1999) ----------------------------------------


def _nonlinearity(s: np.ndarray, fun: str) -> tuple[np.ndarray, np.ndarray]:
    if fun == "logcosh":
        g = np.tanh(s)
        return g, 1 - g**2
    if fun == "exp":
        bell = np.exp(-(s**2) / 2)
        return s * bell, (1 - s**2) * bell
    return s**3, 3 * s**2


def _ica_kernel(x, y, param):
    whiten, rotation, fun = param
    z = whiten.apply(x)
    g, slope = _nonlinearity(z @ rotation.T, fun)
    return np.concatenate([(g.T @ z).ravel(), slope.sum(axis=0)])


def _decorrelate(w: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(w @ w.T)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-300))) @ vectors.T @ w


def fit_ica(
    design: DataFrame,
    moments: list[Moments],
    before: list[Affine],
    n_components: int | None = None,
    fun: str = "logcosh",
    max_iter: int = 200,
    tol: float = 1e-4,
    random_state: int | None = None,
) -> list[Affine]:
    """Whitening from the training moments, then symmetric fixed-point rotation.

    ``moments`` and ``before`` describe the features after the earlier steps; the
    returned maps continue from those features.
    """
    if fun not in ("logcosh", "exp", "cube"):
        raise ModelExecutionError(f"fun must be logcosh, exp or cube, not {fun!r}")
    d = len(moments[0].x_mean)
    limit = int(min(d, min(m.n for m in moments)))
    c = limit if n_components is None else n_components
    if not isinstance(c, int) or not 1 <= c <= limit:
        raise ModelExecutionError(f"n_components={n_components} must be in 1..{limit}")
    whitens = []
    for m in moments:
        values, vectors = np.linalg.eigh(m.xx / m.n)
        top = np.argsort(values)[::-1][:c]
        spread = np.sqrt(np.clip(values[top], 0, None))
        if spread.min() <= 1e-12 * max(spread.max(), 1e-300):
            raise ModelExecutionError(f"fewer than {c} independent directions to whiten")
        whitens.append(Affine.centred(m.x_mean, vectors[:, top] / spread))
    seed = DEFAULT_SEED if random_state is None else random_state
    start = _decorrelate(np.random.default_rng(seed).normal(size=(c, c)))
    rotations = [start.copy() for _ in moments]
    chains = [b.then(w) for b, w in zip(before, whitens)]
    for _ in range(max_iter):
        params = [(chain, r, fun) for chain, r in zip(chains, rotations)]
        sums = fold_sums(design, _ica_kernel, params, c * c + c)
        change = 0.0
        for i, (m, total) in enumerate(zip(moments, sums)):
            old = rotations[i]
            cross, slope = total[: c * c].reshape(c, c) / m.n, total[c * c :] / m.n
            new = _decorrelate(cross - slope[:, None] * old)
            change = max(change, np.abs(np.abs((new * old).sum(axis=1)) - 1).max())
            rotations[i] = new
        if change < tol:
            break
    else:
        note_unfinished("ica", False)
    return [
        w.then(Affine(r.T, np.zeros(c))) for w, r in zip(whitens, rotations)
    ]


# -- non-negative factors (Lee and Seung 2001; Cichocki and Phan 2009) --------------

NNLS_SWEEPS = 30


def nonnegative_codes(x: np.ndarray, h: np.ndarray, sweeps: int = NNLS_SWEEPS) -> np.ndarray:
    """Row-wise non-negative least squares ``x ~ w @ h`` by coordinate descent."""
    gram, target = h @ h.T, h @ x.T
    w = np.maximum(target / np.maximum(np.diag(gram).sum(), 1e-300), 0)
    others = gram - np.diag(np.diag(gram))
    moving = [j for j in range(len(h)) if gram[j, j] > 0]
    for _ in range(sweeps):
        last = w.copy()
        for j in moving:
            step = others[j] @ w
            np.subtract(target[j], step, out=step)
            step /= gram[j, j]
            np.maximum(step, 0, out=w[j])
        if np.array_equal(w, last):  # and so would be all later sweeps
            break
    return w.T


def _nmf_kernel(x, y, param):
    before, h = param
    z = before.apply(x)
    w = nonnegative_codes(z, h)
    loss = ((z - w @ h) ** 2).sum()
    return np.concatenate([(w.T @ w).ravel(), (w.T @ z).ravel(), [loss]])


def _sign_energy_kernel(x, y, param):
    """Squared norms of the positive and negative parts of the projections."""
    before, axes = param
    p = before.apply(x) @ axes
    return np.concatenate(
        [(np.maximum(p, 0) ** 2).sum(axis=0), (np.minimum(p, 0) ** 2).sum(axis=0)]
    )


def _nmf_start(m: Moments, axes: np.ndarray, energy: np.ndarray) -> np.ndarray:
    """Start from the dominant signed half of each singular direction
    (Boutsidis and Gallopoulos 2008), zeros filled with the mean."""
    d, c = axes.shape
    h = np.zeros((c, d))
    for j in range(c):
        sides = []
        for sign, power in ((1, energy[j]), (-1, energy[c + j])):
            half = np.maximum(sign * axes[:, j], 0)
            sides.append((np.sqrt(power) * np.linalg.norm(half), half))
        strength, half = max(sides, key=lambda side: side[0])
        h[j] = np.sqrt(max(strength, 0.0)) * half / max(np.linalg.norm(half), 1e-300)
    fill = max(h.mean(), 1e-12)
    return np.where(h < 1e-6 * fill, fill / 100, h)


def fit_nmf(
    design: DataFrame,
    moments: list[Moments],
    before: list[Affine],
    n_components: int | None = None,
    max_iter: int = 200,
    tol: float = 1e-4,
) -> tuple[list[np.ndarray], list[list[float]]]:
    """Basis matrices per fold model, and the loss of each iteration.

    Given the basis, codes are solved inside the tasks; their Gram and cross
    products are enough to update the basis exactly, so the loss never rises.
    """
    d = len(moments[0].x_mean)
    c = d if n_components in (None, "auto") else n_components
    if not isinstance(c, int) or c < 1:
        raise ModelExecutionError(f"n_components={n_components} must be positive")
    axes = []
    for m in moments:
        raw = m.xx + m.n * np.outer(m.x_mean, m.x_mean)
        values, vectors = np.linalg.eigh(raw)
        found = vectors[:, np.argsort(values)[::-1][:c]]
        axes.append(np.pad(found, ((0, 0), (0, max(0, c - d)))))
    energy = fold_sums(design, _sign_energy_kernel, list(zip(before, axes)), 2 * c)
    bases = [_nmf_start(m, a, e) for m, a, e in zip(moments, axes, energy)]
    losses: list[list[float]] = [[] for _ in moments]
    for _ in range(max_iter):
        sums = fold_sums(design, _nmf_kernel, list(zip(before, bases)), c * c + c * d + 1)
        moving = False
        for i, total in enumerate(sums):
            ww, wx = total[: c * c].reshape(c, c), total[c * c : -1].reshape(c, d)
            losses[i].append(total[-1])
            history = losses[i]
            if len(history) < 2 or history[-2] - history[-1] > tol * history[0]:
                moving = True
                bases[i] = nonnegative_codes_from_gram(ww, wx, bases[i])
        if not moving:
            break
    else:
        note_unfinished("nmf", False)
    return bases, losses


def nonnegative_codes_from_gram(ww, wx, h, sweeps: int = 10) -> np.ndarray:
    """Coordinate-descent update of the basis from WᵀW and WᵀX."""
    h = h.copy()
    for _ in range(sweeps):
        for j in range(len(h)):
            if ww[j, j] > 0:
                step = wx[j] - ww[j] @ h + ww[j, j] * h[j]
                h[j] = np.maximum(step / ww[j, j], 0)
    return h


def _code_gram_kernel(x, y, param):
    before, h, shift = param
    return gram_kernel(nonnegative_codes(before.apply(x), h), y, shift)


def code_moments(design: DataFrame, before: list[Affine], bases: list[np.ndarray], y_mean: float):
    """Training moments of the NMF codes of each fold model."""
    c = len(bases[0])
    shift = np.append(np.zeros(c), y_mean)
    params = [(b, h, shift) for b, h in zip(before, bases)]
    size = c + 1
    sums = fold_sums(design, _code_gram_kernel, params, 1 + size + size * size)
    return [moments_from_gram(s, shift) for s in sums]


# -- support vector regression (Rahimi and Recht 2007 features) ---------------------

FOURIER_FEATURES = 128


def fourier_map(d: int, gamma: float, features: int, seed: int) -> tuple:
    """Frequencies and phases whose cosines approximate the Gaussian kernel."""
    rng = np.random.default_rng(seed)
    return (
        rng.normal(scale=np.sqrt(2 * gamma), size=(d, features)),
        rng.uniform(0, 2 * np.pi, size=features),
    )


_VERSINE = [(-1) ** i / math.factorial(2 * i + 2) for i in range(8)]  # 1 - cos(a), in powers of a * a


def cosines(a: np.ndarray) -> np.ndarray:
    """cos of each value, which ``a`` loses: 1 - cos by its series at a quarter of the angle,
    doubled twice. Within 1e-15 for angles of some turns, and in fewer steps than np.cos."""
    a -= 2 * math.pi * np.rint(a * (0.5 / math.pi))
    a *= 0.25
    a *= a
    v = np.full_like(a, _VERSINE[-1])
    for term in _VERSINE[-2::-1]:
        v *= a
        v += term
    v *= a
    for _ in range(2):
        np.multiply(v, -2.0, out=a)
        a += 4.0
        v *= a
    return np.subtract(1.0, v, out=v)


def _fourier_rows(z: np.ndarray, mapping: tuple) -> np.ndarray:
    """One row for each feature, and one of ones."""
    frequencies, phases = mapping
    f = np.empty((len(phases) + 1, len(z)))
    angles = np.ascontiguousarray(frequencies.T) @ z.T
    angles += phases[:, None]
    np.multiply(cosines(angles), math.sqrt(2 / len(phases)), out=f[:-1])
    f[-1] = 1.0
    return f


def fourier_features(z: np.ndarray, mapping: tuple) -> np.ndarray:
    out = np.empty((len(z), len(mapping[1])))
    for at in _steps(len(z), len(mapping[1])):
        out[at] = _fourier_rows(z[at], mapping)[:-1].T
    return out


def kernel_width(gamma: Any, m: Moments) -> float:
    """Numeric gamma, or the usual ``scale`` / ``auto`` rules."""
    d = len(m.x_mean)
    if gamma == "auto":
        return 1 / d
    if gamma == "scale":
        spread = np.trace(m.xx) / (m.n * d) + np.var(m.x_mean)
        return 1 / (d * spread) if spread > 0 else 1.0
    if not isinstance(gamma, (int, float)) or gamma <= 0:
        raise ModelExecutionError(f"gamma={gamma!r} must be positive, 'scale' or 'auto'")
    return float(gamma)


def _expand(z: np.ndarray, mapping) -> np.ndarray:
    f = z if mapping is None else fourier_features(z, mapping)
    return np.column_stack([f, np.ones(len(f))])


def _expanded_rows(z: np.ndarray, mapping) -> np.ndarray:
    return np.vstack([z.T, np.ones(len(z))]) if mapping is None else _fourier_rows(z, mapping)


def _svr_kernel(x, y, param):
    """Weighted normal equations of the current majoriser, and the loss."""
    chain, mapping, w, floor, epsilon = param
    total = 0.0
    for at in _steps(len(y), len(w)):
        f, goal = _expanded_rows(chain.apply(x[at]), mapping), y[at]
        r = goal - w @ f
        size = np.abs(r)
        excess = np.maximum(size - epsilon, 0)
        # |r|-eps outside the tube is bounded by a parabola touching it at the current r.
        weight = np.where(size <= epsilon, 0.0, 1 / np.maximum(excess, floor))
        total = total + _normal_equations(f, weight, goal - np.sign(r) * epsilon, excess.sum())
    return total


def _hinge_kernel(x, y, param):
    """The same for ``max(0, 1 - s f)``, s = 1 for class 1 and -1 for class 0: with
    u = 1 - s f it is (u + |u|) / 2, and |u| is bounded by a parabola."""
    chain, mapping, w, floor, class_weights = param
    total = 0.0
    for at in _steps(len(y), len(w)):
        f = _expanded_rows(chain.apply(x[at]), mapping)
        hit = y[at] > 0
        s = np.where(hit, 1.0, -1.0)
        own = np.where(hit, class_weights[1], class_weights[0])
        u = 1 - s * (w @ f)
        size = np.maximum(np.abs(u), floor)
        loss = (own * np.maximum(u, 0)).sum()
        total = total + _normal_equations(f, own / (2 * size), s * (1 + size), loss)
    return total


def _normal_equations(f, weight, goal, loss):
    """Of the features in the rows of ``f``, which are weighted in place."""
    root = np.sqrt(weight)
    f *= root
    return np.concatenate([(f @ f.T).ravel(), f @ (root * goal), [loss]])


#: Steps after which the smallest majorised residual stays at 1e-6 of the spread.
FLOOR_STEPS = 16


def _reweighted(
    design: DataFrame, kernel, before: list, mappings: list, start: list, spread: list, extra: list,
    C: float, max_iter: int, tol: float,
) -> tuple[list[np.ndarray], bool]:
    """Weights per fold model that minimise ``|w|^2/2 + C * loss``, the intercept free,
    by reweighted normal equations; the best seen. Also whether all of them settled."""
    weights = list(start)
    size = len(weights[0])
    penalty = np.eye(size)
    penalty[-1, -1] = 1e-9
    best = [(np.inf, w) for w in weights]
    last = [np.inf] * len(weights)
    settled = [False] * len(weights)
    for step in range(max_iter):
        floors = [s * 10.0 ** -min(2 + step / 4, 6) for s in spread]
        params = list(zip(before, mappings, weights, floors, extra))
        sums = fold_sums(design, kernel, params, size * size + size + 1)
        for i, total in enumerate(sums):
            if settled[i]:
                continue
            w = weights[i]
            value = w[:-1] @ w[:-1] / 2 + C * total[-1]
            if value < best[i][0]:
                best[i] = (value, w)
            settled[i] = step >= FLOOR_STEPS and abs(last[i] - value) <= tol * abs(last[i])
            last[i] = value
            a = C * total[: size * size].reshape(size, size)
            weights[i] = np.linalg.solve(a + penalty, C * total[size * size : -1])
        if all(settled):
            break
    return [w for _, w in best], all(settled)


def _mappings(moments: list[Moments], kernel: str, gamma: Any, n_features: int, random_state) -> tuple[list, int]:
    """Feature maps per fold model, and the number of weights with the intercept."""
    if kernel not in ("rbf", "linear"):
        raise ModelExecutionError(f"kernel must be rbf or linear, not {kernel!r}")
    d = len(moments[0].x_mean)
    if kernel == "linear":
        return [None] * len(moments), d + 1
    seed = DEFAULT_SEED if random_state is None else random_state
    return [fourier_map(d, kernel_width(gamma, m), n_features, seed) for m in moments], n_features + 1


def fit_svr(
    design: DataFrame,
    moments: list[Moments],
    before: list[Affine],
    C: float = 1.0,
    epsilon: float = 0.1,
    kernel: str = "rbf",
    gamma: Any = "scale",
    n_features: int = FOURIER_FEATURES,
    max_iter: int = 40,
    tol: float = 1e-3,
    random_state: int | None = None,
) -> list[tuple]:
    """epsilon-insensitive regression on random Fourier features, or linear.

    Minimises ``|w|^2/2 + C * sum max(|y - f(x)| - epsilon, 0)``; returns
    (chain, mapping, weights) per fold model.
    """
    if C <= 0 or epsilon < 0:
        raise ModelExecutionError("C must be positive and epsilon non-negative")
    mappings, size = _mappings(moments, kernel, gamma, n_features, random_state)
    start = [np.append(np.zeros(size - 1), m.y_mean) for m in moments]
    spread = [max(np.sqrt(m.yy / m.n), 1e-12) for m in moments]
    extra = [epsilon] * len(moments)
    weights, done = _reweighted(design, _svr_kernel, before, mappings, start, spread, extra, C, max_iter, tol)
    note_unfinished("svm", done)
    return list(zip(before, mappings, weights))


def predict_svr(x: np.ndarray, param) -> np.ndarray:
    chain, mapping, w = param
    return _expand(chain.apply(x), mapping) @ w


# -- two classes: support vectors and logistic regression ---------------------------

#: Keeps the slope of a sigmoid at zero where all margins are the same.
SLOPE_PENALTY = np.array([1e-6, 0.0])


def fit_svc(
    design: DataFrame,
    moments: list[Moments],
    before: list[Affine],
    C: float = 1.0,
    kernel: str = "rbf",
    gamma: Any = "scale",
    n_features: int = FOURIER_FEATURES,
    max_iter: int = 40,
    tol: float = 1e-3,
    random_state: int | None = None,
    class_weights: list[tuple[float, float]] | None = None,
    probability: bool = False,
) -> list[tuple]:
    """Hinge loss on random Fourier features, or linear, for classes 0 and 1.

    Returns (chain, mapping, weights, sigmoid) per fold model; ``sigmoid`` turns margins
    into probabilities where they are asked for (Platt 1999): a slope and intercept of
    least log loss on the training margins, against targets drawn in from 0 and 1.
    """
    if C <= 0:
        raise ModelExecutionError(f"C={C} must be positive")
    mappings, size = _mappings(moments, kernel, gamma, n_features, random_state)
    extra = class_weights or [(1.0, 1.0)] * len(moments)
    start = [np.zeros(size) for _ in moments]
    spread = [1.0] * len(moments)
    weights, done = _reweighted(design, _hinge_kernel, before, mappings, start, spread, extra, C, max_iter, tol)
    note_unfinished("svc", done)
    sigmoids: list = [None] * len(moments)
    if probability:
        ones = [m.n * m.y_mean for m in moments]  # classes are 0 and 1
        targets = [(1 / (m.n - n + 2), (n + 1) / (n + 2)) for m, n in zip(moments, ones)]
        margins = list(zip(before, mappings, weights))
        sigmoids, done = _newton(design, margins, [(1.0, 1.0)] * len(moments), targets, 2, 1.0, SLOPE_PENALTY, 100, 1e-8)
        note_unfinished("svc probabilities", done)
    return list(zip(before, mappings, weights, sigmoids))


def _logit_kernel(x, y, param):
    """Curvature, gradient and sum of the log loss of classes 0 and 1. ``inner`` weights
    make one feature, the margin, of all of them."""
    (chain, mapping, inner), theta, class_weights, targets = param
    f = _expand(chain.apply(x), mapping)
    if inner is not None:
        f = np.column_stack([f @ inner, np.ones(len(f))])
    hit = y > 0
    own = np.where(hit, class_weights[1], class_weights[0])
    goal = np.where(hit, targets[1], targets[0])
    z = f @ theta
    p = np.exp(-np.logaddexp(0, -z))
    loss = (own * (np.logaddexp(0, z) - goal * z)).sum()
    return np.concatenate([((f * (own * p * (1 - p))[:, None]).T @ f).ravel(), f.T @ (own * (p - goal)), [loss]])


def _newton(
    design: DataFrame, features: list[tuple], class_weights: list, targets: list, size: int,
    C: float, penalty: np.ndarray, max_iter: int, tol: float, free: np.ndarray | None = None,
) -> tuple[list[np.ndarray], bool]:
    """Minimise ``penalty . theta^2 / 2 + C * log loss`` per fold model by Newton steps,
    halved while they do not lower it; until no slope exceeds ``tol``. ``free``: which
    parameters move."""
    free = np.ones(size, bool) if free is None else free
    k = len(features)
    thetas = [np.zeros(size) for _ in range(k)]
    base, steps = [t.copy() for t in thetas], [np.zeros(size) for _ in range(k)]
    lowest, settled = [np.inf] * k, [False] * k
    for _ in range(max_iter):
        params = list(zip(features, thetas, class_weights, targets))
        sums = fold_sums(design, _logit_kernel, params, size * size + size + 1)
        for i, total in enumerate(sums):
            if settled[i]:
                continue
            value = penalty @ thetas[i] ** 2 / 2 + C * total[-1]
            if value > lowest[i] * (1 + 1e-13):
                steps[i] = steps[i] / 2
                settled[i] = np.abs(steps[i]).max() <= 1e-12 * max(np.abs(base[i]).max(), 1e-12)
                thetas[i] = base[i] if settled[i] else base[i] + steps[i]
                continue
            base[i], lowest[i] = thetas[i], value
            slope = C * total[size * size : -1] + penalty * thetas[i]
            if np.abs(slope[free]).max() <= tol:
                settled[i] = True
                continue
            curve = C * total[: size * size].reshape(size, size) + np.diag(penalty)
            curve = curve[np.ix_(free, free)]
            curve += 1e-12 * max(np.trace(curve) / len(curve), 1e-300) * np.eye(len(curve))
            steps[i] = np.zeros(size)
            steps[i][free] = -np.linalg.solve(curve, slope[free])
            thetas[i] = base[i] + steps[i]
            if -slope @ steps[i] <= 1e-14 * abs(value):  # a fall that sums cannot show
                base[i], settled[i] = thetas[i], True
        if all(settled):
            break
    return base, all(settled)


def fit_logistic(
    design: DataFrame,
    moments: list[Moments],
    before: list[Affine],
    C: float = 1.0,
    penalty: str | None = "l2",
    fit_intercept: bool = True,
    max_iter: int = 100,
    tol: float = 1e-4,
    class_weights: list[tuple[float, float]] | None = None,
) -> list[tuple]:
    """Logistic regression of classes 0 and 1, ``|w|^2/2 + C * log loss`` or the loss
    alone; (chain, mapping, weights, sigmoid) as ``fit_svc`` has them."""
    size = len(moments[0].x_mean) + 1
    ridge = np.append(np.ones(size - 1) if penalty == "l2" else np.zeros(size - 1), 0.0)
    free = np.ones(size, bool)
    free[-1] = fit_intercept
    features = [(b, None, None) for b in before]
    targets = [(0.0, 1.0)] * len(moments)
    own = class_weights or [(1.0, 1.0)] * len(moments)
    thetas, done = _newton(design, features, own, targets, size, C, ridge, max_iter, tol, free)
    note_unfinished("logreg", done)
    return [(b, None, t, np.array([1.0, 0.0])) for b, t in zip(before, thetas)]


def predict_two_classes(x: np.ndarray, param) -> np.ndarray:
    """Columns: margin, and the probability of class 1 (NaN where there is none)."""
    chain, mapping, w, sigmoid = param
    margin = _expand(chain.apply(x), mapping) @ w
    if sigmoid is None:
        return np.column_stack([margin, np.full(len(margin), np.nan)])
    return np.column_stack([margin, np.exp(-np.logaddexp(0, -(margin * sigmoid[0] + sigmoid[1])))])


# -- robust linear regression by gradient steps -------------------------------------


def _huber_kernel(x, y, param):
    """Reweighted normal equations of a robust or tube loss with an intercept."""
    chain, w, epsilon, loss, floor = param
    f = np.column_stack([chain.apply(x), np.ones(len(y))])
    r = y - f @ w
    size = np.maximum(np.abs(r), floor)
    if loss == "huber":
        weight, goal = np.where(size <= epsilon, 1.0, epsilon / size), y
    else:
        outside = np.abs(r) > epsilon
        excess = np.maximum(np.abs(r) - epsilon, floor)
        scale = 1 / (2 * excess) if loss == "epsilon_insensitive" else np.ones(len(y))
        weight, goal = np.where(outside, 2 * scale, 0.0), y - np.sign(r) * epsilon
    fw = f * weight[:, None]
    return np.concatenate([(fw.T @ f).ravel(), fw.T @ goal])


def fit_robust_linear(
    design: DataFrame,
    moments: list[Moments],
    before: list[Affine],
    loss: str,
    alpha: float,
    epsilon: float = 0.1,
    max_iter: int = 50,
    tol: float = 1e-6,
) -> list[tuple[np.ndarray, float]]:
    """Mean robust loss plus ``alpha * |w|^2 / 2``, by reweighted least squares."""
    d = len(moments[0].x_mean)
    weights = [np.append(np.zeros(d), m.y_mean) for m in moments]
    floors = [1e-8 * max(np.sqrt(m.yy / m.n), 1e-12) for m in moments]
    for _ in range(max_iter):
        params = [(b, w, epsilon, loss, f) for b, w, f in zip(before, weights, floors)]
        sums = fold_sums(design, _huber_kernel, params, (d + 1) ** 2 + d + 1)
        change = 0.0
        for i, (m, total) in enumerate(zip(moments, sums)):
            a = total[: (d + 1) ** 2].reshape(d + 1, d + 1) / m.n
            penalty = alpha * np.eye(d + 1)
            penalty[-1, -1] = 1e-12
            new = np.linalg.solve(a + penalty + 1e-14 * np.eye(d + 1), total[(d + 1) ** 2 :] / m.n)
            change = max(change, np.abs(new - weights[i]).max() / max(np.abs(new).max(), 1e-12))
            weights[i] = new
        if change < tol:
            break
    else:
        note_unfinished("sgd", False)
    return [(w[:-1], float(w[-1])) for w in weights]


# -- multi-layer perceptron regression ----------------------------------------------


def _unpack_layers(theta: np.ndarray, sizes: list[int]) -> list[tuple]:
    layers, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        layers.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


# Activations and their slopes written in terms of the output.
_ACTIVATIONS = {
    "identity": (lambda a: a, lambda o: np.ones_like(o)),
    "relu": (lambda a: np.maximum(a, 0), lambda o: (o > 0).astype(float)),
    "tanh": (np.tanh, lambda o: 1 - o**2),
    "logistic": (lambda a: 1 / (1 + np.exp(-a)), lambda o: o * (1 - o)),
}


def _forward(f: np.ndarray, layers: list[tuple], activation: str) -> list[np.ndarray]:
    act = _ACTIVATIONS[activation][0]
    outs = [f]
    for i, (w, b) in enumerate(layers):
        a = outs[-1] @ w
        a += b
        outs.append(a if i == len(layers) - 1 else act(a))
    return outs


def mlp_gradient(f, y, theta, sizes, activation) -> tuple[np.ndarray, float]:
    """Summed gradient and loss of half the squared error."""
    layers = _unpack_layers(theta, sizes)
    slope = _ACTIVATIONS[activation][1]
    outs = _forward(f, layers, activation)
    delta = outs[-1] - y[:, None]
    loss = float((delta**2).sum() / 2)
    grads: list[np.ndarray] = []
    ones = np.ones(len(f))
    for i in range(len(layers) - 1, -1, -1):
        grads = [(outs[i].T @ delta).ravel(), ones @ delta, *grads]
        if i:
            delta = delta @ layers[i][0].T
            delta *= slope(outs[i])
    return np.concatenate(grads), loss


FULL_GRADIENT = 4.0


def _mlp_kernel(x, y, param):
    """Gradient and loss summed over the rows, and their number."""
    chain, theta, sizes, activation, centre, spread = param
    total = 0.0
    for at in _steps(len(y), max(sizes)):
        grad, loss = mlp_gradient(chain.apply(x[at]), (y[at] - centre) / spread, theta, sizes, activation)
        total = total + np.concatenate([grad, [loss, len(y[at])]])
    return total


def fit_mlp(
    design: DataFrame,
    moments: list[Moments],
    before: list[Affine],
    hidden_layer_sizes: tuple = (100,),
    activation: str = "relu",
    alpha: float = 1e-4,
    learning_rate_init: float = 0.01,
    max_iter: int = 200,
    tol: float = 1e-4,
    n_iter_no_change: int = 10,
    random_state: int | None = None,
) -> list[tuple]:
    """Adam on the full gradient, all fold models at once.

    One iteration is one pass that sums the gradient over all training rows, so neither
    partitions nor batches change the model. The target is standardised while fitting,
    so one step size suits any scale; full gradients bear larger steps than mini-batches
    do, hence ``learning_rate_init`` times ``FULL_GRADIENT``.
    """
    if activation not in _ACTIVATIONS:
        raise ModelExecutionError(f"unknown activation {activation!r}")
    hidden = hidden_layer_sizes if isinstance(hidden_layer_sizes, (list, tuple)) else [hidden_layer_sizes]
    sizes = [len(moments[0].x_mean), *map(int, hidden), 1]
    rng = np.random.default_rng(DEFAULT_SEED if random_state is None else random_state)
    factor = 2.0 if activation == "logistic" else 6.0
    start = np.concatenate(
        [
            np.concatenate([rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)])
            for a, b in zip(sizes, sizes[1:])
            for bound in [np.sqrt(factor / (a + b))]
        ]
    )
    targets = [(m.y_mean, max(np.sqrt(m.yy / m.n), 1e-12)) for m in moments]
    thetas = [start.copy() for _ in moments]
    best = [(np.inf, start)] * len(moments)
    first = [np.zeros_like(start) for _ in moments]
    second = [np.zeros_like(start) for _ in moments]
    idle = 0
    for step in range(1, max_iter + 1):
        params = [(b, t, sizes, activation, c, s) for b, t, (c, s) in zip(before, thetas, targets)]
        sums = fold_sums(design, _mlp_kernel, params, len(start) + 2)
        improved = False
        for i, total in enumerate(sums):
            loss = (total[-2] + alpha / 2 * (thetas[i] @ thetas[i])) / total[-1]
            if not np.isfinite(loss):
                raise ModelExecutionError("multi-layer perceptron diverged")
            improved = improved or loss < best[i][0] - tol
            if loss < best[i][0]:
                best[i] = (loss, thetas[i])
            grad = (total[:-2] + alpha * thetas[i]) / total[-1]
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            move = (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            thetas[i] = thetas[i] - FULL_GRADIENT * learning_rate_init * move
        idle = 0 if improved else idle + 1
        if idle >= n_iter_no_change:
            break
    else:
        note_unfinished("mlp", False)
    return [
        (b, theta, sizes, activation, c, s)
        for b, (_, theta), (c, s) in zip(before, best, targets)
    ]


def predict_mlp(x: np.ndarray, param) -> np.ndarray:
    chain, theta, sizes, activation, centre, spread = param
    out = _forward(chain.apply(x), _unpack_layers(theta, sizes), activation)[-1]
    return out[:, 0] * spread + centre
