"""Linear models solved from training moments; no pass over the data."""

from __future__ import annotations

import numpy as np

from ..errors import ModelExecutionError
from .moments import Moments

TINY = np.finfo(float).eps


def pls(m: Moments, n_components: int = 2, scale: bool = True) -> tuple[np.ndarray, float]:
    """Single-target partial least squares by the kernel algorithm (Dayal and
    MacGregor 1997): components come from XᵀX and Xᵀy alone."""
    d = len(m.xy)
    if not 1 <= n_components <= min(d, m.n):
        raise ModelExecutionError(
            f"n_components={n_components} must be in 1..min({d} features, {int(m.n)} rows)"
        )
    sx, sy = np.ones(d), 1.0
    if scale:
        sx = np.sqrt(np.diag(m.xx) / max(m.n - 1, 1))
        sx[sx == 0] = 1.0
        sy = np.sqrt(m.yy / max(m.n - 1, 1)) or 1.0
    xx = m.xx / np.outer(sx, sx)
    xy = m.xy / (sx * sy)
    floor = 10 * TINY * max(np.linalg.norm(xy), 1e-300)
    rotations, loadings, beta = [], [], np.zeros(d)
    for _ in range(n_components):
        norm = np.linalg.norm(xy)
        if norm <= floor:  # the target is explained
            break
        r = xy / norm
        for p, q in zip(loadings, rotations):
            r = r - (p @ (xy / norm)) * q
        weight = r @ xx @ r
        if weight <= 0:
            break
        p = xx @ r / weight
        q = r @ xy / weight
        xy = xy - p * q * weight
        beta += r * q
        rotations.append(r)
        loadings.append(p)
    beta = beta * sy / sx
    return beta, m.y_mean - float(m.x_mean @ beta)


def penalised_least_squares(
    m: Moments, alpha: float, l1_ratio: float = 0.0, tol: float = 1e-10, max_iter: int = 10_000
) -> tuple[np.ndarray, float]:
    """Minimiser of mean squared error / 2 plus the elastic-net penalty."""
    xx, xy = m.xx / m.n, m.xy / m.n
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    if l1 == 0:
        try:
            beta = np.linalg.solve(xx + l2 * np.eye(len(xy)), xy)
        except np.linalg.LinAlgError:
            beta = np.linalg.lstsq(xx + l2 * np.eye(len(xy)), xy, rcond=None)[0]
    else:  # coordinate descent on the Gram matrix
        beta = np.zeros(len(xy))
        for _ in range(max_iter):
            before = beta.copy()
            for j in range(len(xy)):
                rest = xy[j] - xx[j] @ beta + xx[j, j] * beta[j]
                beta[j] = np.sign(rest) * max(abs(rest) - l1, 0) / (xx[j, j] + l2 or 1.0)
            if np.abs(beta - before).max() <= tol * max(np.abs(beta).max(), TINY):
                break
    return beta, m.y_mean - float(m.x_mean @ beta)
