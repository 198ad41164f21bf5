import numpy as np
import pytest
from pyspark.sql import functions as F

from foldyard.errors import ModelExecutionError
from foldyard.operators.features import (
    Affine,
    f_scores_classes,
    f_scores_regression,
    keep_percentile,
    principal_axes,
    row_norm,
    standardise,
)
from foldyard.operators.linear import penalised_least_squares, pls
from foldyard.operators.moments import (
    Moments,
    fold_moments_columns,
    fold_moments_design,
    train_moments,
)
from foldyard.operators.mutual_info import train_mutual_info

K, D = 3, 4


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, D)) @ rng.normal(size=(D, D)) + [1e4, 0, -3, 50]
    y = x[:, 0] * 0.5 - x[:, 2] + rng.normal(size=400)
    fold = rng.integers(0, K, 400)
    rows = [(int(f), float(t), *map(float, r)) for f, t, r in zip(fold, y, x)]
    schema = "fold int, y double, " + ", ".join(f"x{i} double" for i in range(D))
    return spark.createDataFrame(rows, schema).repartition(4).cache(), x, y, fold


def _moments(x, y):
    v = np.column_stack([x, y])
    return Moments(len(y), v.mean(axis=0), np.cov(v.T, ddof=0) * len(y))


def test_both_moment_passes_give_the_training_moments(data):
    df, x, y, fold = data
    names = [f"x{i}" for i in range(D)]
    design = df.select("fold", "y", F.array(*names).alias("x"))
    by_columns = train_moments(fold_moments_columns(df, names, "y", K))
    by_arrow = train_moments(fold_moments_design(design, K, np.array([1e4, 0, 0, 50, 5e3])))
    for m in range(K):
        expected = _moments(x[fold != m], y[fold != m])
        for got in (by_columns[m], by_arrow[m]):
            assert got.n == expected.n
            np.testing.assert_allclose(got.mean, expected.mean, rtol=1e-10)
            np.testing.assert_allclose(got.co, expected.co, rtol=1e-7, atol=1e-6)


def test_mapped_moments_equal_moments_of_mapped_data(data):
    _, x, y, _ = data
    step = Affine(np.random.default_rng(1).normal(size=(D, 2)), np.array([3.0, -1.0]))
    got = _moments(x, y).mapped(step.weights, step.offset)
    expected = _moments(step.apply(x), y)
    np.testing.assert_allclose(got.mean, expected.mean)
    np.testing.assert_allclose(got.co, expected.co, rtol=1e-8, atol=1e-5)


def test_standardise_uses_population_deviation_and_keeps_constants():
    x = np.column_stack([np.arange(8.0), np.full(8, 5.0)])
    z = standardise(_moments(x, np.zeros(8))).apply(x)
    np.testing.assert_allclose(z[:, 0], (x[:, 0] - 3.5) / np.std(x[:, 0]))
    np.testing.assert_allclose(z[:, 1], 0, atol=1e-12)
    raw = standardise(_moments(x, np.zeros(8)), with_mean=False, with_std=False).apply(x)
    np.testing.assert_array_equal(raw, x)


@pytest.mark.parametrize("norm,length", [("l1", 7.0), ("l2", 5.0), ("max", 4.0)])
def test_row_norm(spark, norm, length):
    frame = spark.createDataFrame([(3.0, -4.0), (0.0, 0.0)], "a double, b double")
    columns = row_norm([F.col("a"), F.col("b")], norm)
    got = {tuple(r) for r in frame.select(*columns).collect()}
    assert got == {(3 / length, -4 / length), (0.0, 0.0)}


def test_row_norm_rejects_unknown_names():
    with pytest.raises(ModelExecutionError):
        row_norm([F.lit(1.0)], "l3")


def test_percentile_keeps_the_top_share_and_breaks_ties_early():
    assert keep_percentile(np.array([1.0, 2.0]), 10).tolist() == [1]
    assert keep_percentile(np.array([3.0, 1.0, 2.0, 4.0]), 50).tolist() == [0, 3]
    assert keep_percentile(np.array([1.0, 1.0, 1.0, 1.0]), 50).tolist() == [0, 1]
    assert keep_percentile(np.array([np.nan, 1.0, 2.0, 0.5]), 25).tolist() == [2]
    assert keep_percentile(np.arange(3.0), 100).tolist() == [0, 1, 2]
    assert keep_percentile(np.arange(3.0), 0).tolist() == []
    with pytest.raises(ModelExecutionError):
        keep_percentile(np.arange(3.0), 101)


def test_f_scores(data):
    _, x, y, _ = data
    r = np.array([np.corrcoef(x[:, i], y)[0, 1] for i in range(D)])
    np.testing.assert_allclose(
        f_scores_regression(_moments(x, y)), r**2 / (1 - r**2) * (len(y) - 2), rtol=1e-6
    )
    label = np.random.default_rng(4).integers(0, 3, len(y))
    centred = x - x.mean(axis=0)
    n = np.array([(label == c).sum() for c in range(3)])
    sums = np.stack([centred[label == c].sum(axis=0) for c in range(3)])
    within = sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum(axis=0) for c in range(3))
    between = ((sums / n[:, None]) ** 2 * n[:, None]).sum(axis=0)
    expected = (between / 2) / (within / (len(y) - 3))
    np.testing.assert_allclose(f_scores_classes(_moments(x, label), n, sums), expected, rtol=1e-6)


def test_pca_matches_the_singular_vectors(data):
    _, x, y, _ = data
    step = principal_axes(_moments(x, y), 2)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    z = step.apply(x)
    np.testing.assert_allclose(np.abs(step.weights), np.abs(vt[:2].T), atol=1e-6)
    np.testing.assert_allclose(z.mean(axis=0), 0, atol=1e-6)
    np.testing.assert_allclose((z**2).sum(axis=0), s[:2] ** 2, rtol=1e-6)
    largest = np.abs(step.weights).argmax(axis=0)
    assert (step.weights[largest, [0, 1]] > 0).all()
    share = s[0] ** 2 / (s**2).sum()
    assert principal_axes(_moments(x, y), float(share) - 0.01).weights.shape[1] == 1
    assert principal_axes(_moments(x, y), float(share) + 0.001).weights.shape[1] == 2
    np.testing.assert_allclose(
        principal_axes(_moments(x, y), 2, whiten=True).apply(x).std(axis=0, ddof=1), 1
    )
    with pytest.raises(ModelExecutionError):
        principal_axes(_moments(x, y), 5)


def test_binned_mutual_information(data):
    df, x, y, fold = data
    got = train_mutual_info(df, [f"x{i}" for i in range(D)], "y", K, bins=5)

    def bins(v):
        edges = np.unique(np.sort(v)[[i * len(v) // 5 for i in range(1, 5)]])
        return np.searchsorted(edges, v, side="right")

    for m in range(K):
        keep = fold != m
        for i in range(D):
            table = np.zeros((5, 5))
            np.add.at(table, (bins(x[keep, i]), bins(y[keep])), 1)
            p = table / table.sum()
            outer = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
            hit = p > 0
            assert got[m, i] == pytest.approx((p[hit] * np.log(p[hit] / outer[hit])).sum())


def _nipals(x, y, n_components):
    """Textbook single-target PLS by deflating the data itself."""
    xm, ym, xs, ys = x.mean(0), y.mean(), x.std(0, ddof=1), y.std(ddof=1)
    a, b = (x - xm) / xs, (y - ym) / ys
    w_all, p_all, q_all = [], [], []
    for _ in range(n_components):
        w = a.T @ b
        w /= np.linalg.norm(w)
        t = a @ w
        p, q = a.T @ t / (t @ t), b @ t / (t @ t)
        a, b = a - np.outer(t, p), b - q * t
        w_all.append(w), p_all.append(p), q_all.append(q)
    w, p = np.array(w_all).T, np.array(p_all).T
    beta = w @ np.linalg.solve(p.T @ w, np.array(q_all)) * ys / xs
    return beta, ym - xm @ beta


@pytest.mark.parametrize("n_components", [1, 2, 3, 4])
def test_pls_equals_deflation_of_the_data(data, n_components):
    _, x, y, _ = data
    beta, intercept = pls(_moments(x, y), n_components)
    expected, offset = _nipals(x, y, n_components)
    np.testing.assert_allclose(beta, expected, rtol=1e-5, atol=1e-8)
    assert intercept == pytest.approx(offset, rel=1e-5)


def test_pls_stops_when_the_target_is_explained():
    x = np.column_stack([np.arange(6.0), np.arange(6.0) + 1])
    beta, intercept = pls(_moments(x, x.sum(axis=1)), 2)
    np.testing.assert_allclose(x @ beta + intercept, x.sum(axis=1))
    with pytest.raises(ModelExecutionError, match="n_components"):
        pls(_moments(x, x.sum(axis=1)), 3)


def test_ridge_gradient_is_zero_and_lasso_meets_its_conditions(data):
    _, x, y, _ = data
    z = (x - x.mean(0)) / x.std(0)
    m = _moments(z, y)
    for alpha in (0.0, 0.3):
        beta, intercept = penalised_least_squares(m, alpha)
        r = y - z @ beta - intercept
        np.testing.assert_allclose(z.T @ r / len(y), alpha * beta, atol=1e-8)
        assert abs(r.sum()) < 1e-6
    beta, intercept = penalised_least_squares(m, 0.5, 1.0)
    slope = z.T @ (y - z @ beta - intercept) / len(y)
    assert (np.abs(slope) <= 0.5 + 1e-6).all()
    np.testing.assert_allclose(slope[beta != 0], 0.5 * np.sign(beta[beta != 0]), atol=1e-6)
