import numpy as np
import pytest

from foldyard.errors import ModelExecutionError
from foldyard.operators import iterative as it
from foldyard.operators import mllib
from foldyard.operators.features import Affine
from foldyard.operators.linear import penalised_least_squares
from foldyard.operators.moments import fold_moments_design, train_moments
from foldyard.operators.sums import out_of_fold

K, N = 3, 1500


def _design(spark, x, y, fold):
    rows = [(int(f), float(t), r) for f, t, r in zip(fold, y, x.tolist())]
    return spark.createDataFrame(rows, "fold int, y double, x array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def curved(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(N, 2))
    y = np.sin(1.5 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(size=N) * 0.1
    fold = rng.integers(0, K, N)
    design = _design(spark, x, y, fold)
    return design, train_moments(fold_moments_design(design, K, np.zeros(3))), x, y, fold


def _r2(frame):
    rows = frame.collect()
    y, p = np.array([r["y"] for r in rows]), np.array([r["z"][0] for r in rows])
    assert len(y) == N
    return 1 - ((y - p) ** 2).mean() / y.var()


def test_ica_recovers_the_mixed_sources(spark):
    rng = np.random.default_rng(1)
    sources = np.column_stack(
        [rng.uniform(-1, 1, N), rng.laplace(size=N), rng.choice([-1, 1], N) * rng.uniform(0.5, 1, N)]
    )
    x, fold = sources @ rng.normal(size=(3, 3)), rng.integers(0, K, N)
    design = _design(spark, x, x[:, 0], fold)
    moments = train_moments(fold_moments_design(design, K, np.zeros(4)))
    for step in it.fit_ica(design, moments, [Affine.identity(3)] * K):
        z = step.apply(x)
        match = np.abs(np.corrcoef(z.T, sources.T)[:3, 3:])
        assert (match.max(axis=1) > 0.98).all() and len(set(match.argmax(axis=1))) == 3
        np.testing.assert_allclose(z.std(axis=0), 1, atol=0.1)
    with pytest.raises(ModelExecutionError):
        it.fit_ica(design, moments, [Affine.identity(3)] * K, n_components=4)


def test_nmf_loss_falls_and_factors_are_non_negative(spark):
    rng = np.random.default_rng(2)
    x = rng.gamma(1, size=(N, 2)) @ rng.gamma(1, size=(2, 5)) + rng.uniform(0, 0.05, (N, 5))
    design = _design(spark, x, x[:, 0], rng.integers(0, K, N))
    moments = train_moments(fold_moments_design(design, K, np.zeros(6)))
    bases, losses = it.fit_nmf(design, moments, [Affine.identity(5)] * K, 2, max_iter=30)
    for basis, history in zip(bases, losses):
        assert (basis >= 0).all()
        assert all(b <= a * (1 + 1e-9) for a, b in zip(history, history[1:]))
        codes = it.nonnegative_codes(x, basis)
        assert (codes >= 0).all()
        assert ((x - codes @ basis) ** 2).sum() < 0.01 * (x**2).sum()


def test_row_codes_satisfy_the_optimality_conditions():
    rng = np.random.default_rng(3)
    x, h = rng.gamma(1, size=(50, 6)), rng.gamma(1, size=(3, 6))
    w = it.nonnegative_codes(x, h, sweeps=500)
    slope = (w @ h - x) @ h.T
    assert (slope > -1e-6).all() and np.abs(slope * w).max() < 1e-5


def test_mlp_gradient_matches_differences():
    rng = np.random.default_rng(4)
    f, y, sizes = rng.normal(size=(20, 3)), rng.normal(size=20), [3, 4, 1]
    theta = rng.normal(size=3 * 4 + 4 + 4 + 1)
    for activation in ("tanh", "logistic", "identity"):
        grad, _ = it.mlp_gradient(f, y, theta, sizes, activation)
        for i in range(len(theta)):
            step = np.zeros_like(theta)
            step[i] = 1e-6
            up = it.mlp_gradient(f, y, theta + step, sizes, activation)[1]
            down = it.mlp_gradient(f, y, theta - step, sizes, activation)[1]
            assert grad[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_mlp_does_not_depend_on_partitions(curved):
    design, moments, *_ = curved
    fits = [
        it.fit_mlp(design.repartition(n), moments, [Affine.identity(2)] * K, (8,), max_iter=15) for n in (1, 8)
    ]
    for one, other in zip(*fits):
        np.testing.assert_allclose(one[1], other[1], rtol=1e-6, atol=1e-9)


def test_mlp_beats_a_line(curved):
    design, moments, *_ = curved
    fitted = it.fit_mlp(design, moments, [Affine.identity(2)] * K, (16,), max_iter=60)
    lines = [penalised_least_squares(m, 0.0) for m in moments]
    maps = [Affine(beta[:, None], np.array([intercept])) for beta, intercept in lines]
    line = _r2(out_of_fold(design, lambda x, a: a.apply(x), maps))
    assert _r2(out_of_fold(design, it.predict_mlp, fitted)) > max(line + 0.05, 0.9)


def test_svr_fits_a_curve(curved):
    design, moments, *_ = curved
    fitted = it.fit_svr(design, moments, [Affine.identity(2)] * K, n_features=64, max_iter=12)
    assert _r2(out_of_fold(design, it.predict_svr, fitted)) > 0.95


def test_linear_svr_reaches_the_minimum_of_its_objective(curved):
    design, moments, x, y, fold = curved
    (_, _, w), *_ = it.fit_svr(
        design, moments, [Affine.identity(2)] * K, kernel="linear", max_iter=60, tol=1e-6
    )
    f = np.column_stack([x, np.ones(N)])[fold != 0]
    goal = y[fold != 0]

    def objective(v):
        return v[:-1] @ v[:-1] / 2 + np.maximum(np.abs(goal - f @ v) - 0.1, 0).sum()

    v = w.copy()
    for step in range(4000):  # plain subgradient descent from the found point
        r = goal - f @ v
        slope = -(f * (np.sign(r) * (np.abs(r) > 0.1))[:, None]).sum(axis=0)
        v = v - 1e-3 / (1 + step) ** 0.6 * (slope + np.append(v[:-1], 0)) / len(goal) * 10
        if objective(v) < objective(w) * 0.995:
            pytest.fail(f"objective {objective(w)} can fall to {objective(v)}")


def test_huber_ignores_outliers(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(N, 1))
    y = 2 * x[:, 0] + 1 + rng.normal(size=N) * 0.1
    y[rng.random(N) < 0.1] += 100
    design = _design(spark, x, y, rng.integers(0, K, N))
    moments = train_moments(fold_moments_design(design, K, np.zeros(2)))
    for beta, intercept in it.fit_robust_linear(
        design, moments, [Affine.identity(1)] * K, "huber", 1e-6, 0.5
    ):
        assert beta[0] == pytest.approx(2, abs=0.1) and intercept == pytest.approx(1, abs=0.15)


@pytest.fixture(scope="module")
def halves(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(N, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=N) > 0.8).astype(float)
    fold = rng.integers(0, K, N)
    design = _design(spark, x, y, fold)
    return design, train_moments(fold_moments_design(design, K, np.zeros(3))), x, y, fold


@pytest.mark.parametrize("penalty, intercept", [("l2", True), ("l2", False), (None, True)])
def test_logistic_slopes_vanish_at_the_weights(halves, penalty, intercept):
    design, moments, x, y, fold = halves
    own = [(1.0, 3.0)] * K
    fitted = it.fit_logistic(
        design, moments, [Affine.identity(2)] * K, C=0.05, penalty=penalty, fit_intercept=intercept, class_weights=own
    )
    for m, (_, _, w, _) in enumerate(fitted):
        f, goal = np.column_stack([x, np.ones(N)])[fold != m], y[fold != m]
        p = 1 / (1 + np.exp(-(f @ w)))
        slope = 0.05 * f.T @ (np.where(goal > 0, 3.0, 1.0) * (p - goal)) + (penalty == "l2") * np.append(w[:-1], 0)
        assert np.abs(slope[: 2 + intercept]).max() <= 1e-4
        assert intercept or w[-1] == 0


def test_hinge_reaches_the_minimum_of_its_objective(halves):
    design, moments, x, y, fold = halves
    (_, _, w, sigmoid), *_ = it.fit_svc(
        design, moments, [Affine.identity(2)] * K, kernel="linear", max_iter=80, tol=1e-7, probability=True
    )
    f, s = np.column_stack([x, np.ones(N)])[fold != 0], 2 * y[fold != 0] - 1

    def objective(v):
        return v[:-1] @ v[:-1] / 2 + np.maximum(1 - s * (f @ v), 0).sum()

    rng = np.random.default_rng(0)
    for _ in range(3000):
        assert objective(w + rng.normal(size=3) * 10 ** rng.uniform(-4, 0)) >= objective(w) * (1 - 1e-4)
    z = (f @ w) * sigmoid[0] + sigmoid[1]
    p = 1 / (1 + np.exp(-z))
    assert abs(p.mean() - (s > 0).mean()) < 0.01  # the intercept balances the sigmoid
    edges = np.quantile(p, [0, 0.25, 0.5, 0.75, 1])
    for low, high in zip(edges, edges[1:]):
        inside = (p >= low) & (p <= high)
        assert abs(p[inside].mean() - (s[inside] > 0).mean()) < 0.08


def test_constant_margins_have_the_share_of_the_class_as_probability(spark):
    rng = np.random.default_rng(2)
    y, fold = (rng.random(N) < 0.2).astype(float), rng.integers(0, K, N)
    design = _design(spark, np.zeros((N, 1)), y, fold)
    moments = train_moments(fold_moments_design(design, K, np.zeros(2)))
    fitted = it.fit_svc(design, moments, [Affine.identity(1)] * K, kernel="linear", probability=True)
    for m, param in enumerate(fitted):
        p = it.predict_two_classes(np.zeros((1, 1)), param)[0, 1]
        assert abs(p - y[fold != m].mean()) < 0.01


def test_fits_that_stop_early_warn(halves):
    design, moments, *_ = halves
    with pytest.warns(it.UnfinishedFit, match="svc"):
        it.fit_svc(design, moments, [Affine.identity(2)] * K, kernel="linear", max_iter=2)
    with pytest.warns(it.UnfinishedFit, match="mlp"):
        it.fit_mlp(design, moments, [Affine.identity(2)] * K, (2,), max_iter=1)


def test_class_weights():
    assert mllib.class_weights(None, ["a", "b"], [3, 1]) is None
    assert mllib.class_weights("balanced", ["a", "b"], [3, 1]) == [4 / 6, 2.0]
    assert mllib.class_weights("balanced", ["a", "b", "c"], [3, 1, 0]) == [4 / 6, 2.0, 0.0]
    assert mllib.class_weights({"b": 2}, ["a", "b"], [3, 1]) == [1.0, 2.0]
    assert mllib.class_weights({"1": 5}, [0, 1], [3, 1]) == [1.0, 5.0]
    for bad in ("even", {"z": 1}):
        with pytest.raises(ModelExecutionError):
            mllib.class_weights(bad, ["a", "b"], [3, 1])
