"""Regression trees on cells, against Spark ML's and trees grown row by row."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldyard.operators import cells as ce
from foldyard.operators import iterative as it
from foldyard.plans.dataset import Dataset
from foldyard.plans.engine import Engine
from foldyard.plans.experiments import expand


def _search(**params):
    return {
        "scale": {"enabled": ["std"]}, "filter": {"enabled": ["none"]}, "reduction": {"enabled": ["none"]},
        "model": {"enabled": list(params), "params": params},
    }


@pytest.fixture(scope="module")
def data(spark):
    """Two columns have more values than bins."""
    a, b, c = F.abs(F.hash("id", F.lit(1))) % 60, F.abs(F.hash("id", F.lit(2))) % 9, F.abs(F.hash("id", F.lit(3))) % 41
    fold = (F.col("id") % 3).cast("int")
    rows = spark.range(960, numPartitions=4).select(fold.alias("f"), a.alias("a"), b.alias("b"), (c / 7).alias("c"))
    noisy = rows.withColumn("y", F.col("a") * F.col("b") + F.sin("c") * 40 + F.hash("a", "c") % 7)
    return Dataset.build(noisy, ["a", "b", "c"], "y", "regression", "f")


def _run(data, monkeypatch, cells, **params):
    if not cells:
        monkeypatch.setattr(ce, "CELLS", 0)
    detailed, failed = Engine(data, "regression", ["r2"]).run(expand("regression", {"search": _search(**params)}))
    assert not failed
    return [row[-1] for row in detailed]


def test_trees_on_cells_are_those_of_spark(data, monkeypatch):
    """Without draws both are exact; cuts of up to 10,000 rows are the same."""
    params = {"gbr": {"n_estimators": 12, "max_depth": 3}, "bag": {"n_estimators": 1, "bootstrap": False, "max_depth": 5}}
    on_cells = _run(data, monkeypatch, True, **params)
    assert on_cells == pytest.approx(_run(data, monkeypatch, False, **params), abs=1e-9)


def test_forests_need_no_pass_for_each_level(data, monkeypatch):
    """Before, every level of every tree read the rows again."""
    monkeypatch.setattr(Engine, "_predict_mllib", lambda *a: pytest.fail("a fit of Spark ML"))
    forest, bagging = np.array(_run(data, monkeypatch, True, rf={}, bag={})).reshape(2, 3)
    assert (forest > 0.9).all() and (bagging > 0.88).all() and (forest != bagging).any()


@pytest.mark.parametrize("chunk", [50, 1 << 20])
def test_sums_of_draws_give_the_trees_of_the_drawn_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(ce, "CHUNK", chunk)
    monkeypatch.setattr(ce, "draws", lambda rng, n, rate, bootstrap: np.full(n, 2, np.uint8))
    rows = spark.range(300).select(
        (F.col("id") % 20).cast("int").alias("cell"), F.expr("id % 20 div 5 + id % 3").cast("double").alias("y"),
        (F.col("id") % 4 > 0).alias("train"),
    )
    cuts = [[0.5, 1.5, 2.5, 3.5], [0.5, 1.5, 2.5]]
    found = {r["cell"]: r["p"] for r in ce.forest(rows, cuts, 5, 1.0, True, 12, 1, 0.0, 0, 3).collect()}
    y = np.array([[i % 20 // 5 + i % 3 for i in range(300) if i % 20 == c and i % 4] or [np.nan] for c in range(20)], dtype=object)
    assert set(found) == set(range(20))
    for c in range(20):
        if c % 4:  # cells of 0 modulo 4 have test rows alone
            assert found[c] == pytest.approx(np.mean(y[c]))


def test_draws_are_poisson_counts():
    rng = np.random.default_rng(0)
    for rate in (1.0, 0.4):
        n = np.bincount(ce.draws(rng, 400_000, rate, True), minlength=6)[:6] / 400_000
        assert n == pytest.approx([math.exp(-rate) * rate**i / math.factorial(i) for i in range(6)], abs=3e-3)
    assert ce.draws(rng, 9, 1.0, False).tolist() == [1] * 9
    assert ce.draws(rng, 400_000, 0.3, False).mean() == pytest.approx(0.3, abs=5e-3)


def test_cuts_of_wide_columns_are_ranks_of_the_training_rows(spark, monkeypatch):
    monkeypatch.setattr(ce, "VALUES", 10)
    frame = spark.range(100).select((F.col("id") % 2).cast("int").alias("fold"), F.col("id").cast("double").alias("x0"))
    assert ce.train_cuts(frame, ["x0"], 2, 5) == [[[20.0, 40.0, 60.0, 80.0]], [[19.0, 39.0, 59.0, 79.0]]]


def test_cosines_in_few_steps():
    a = np.concatenate([np.linspace(-60, 60, 10_001), [0.0, np.pi, -np.pi]])
    assert np.abs(it.cosines(a.copy()) - np.cos(a)).max() < 5e-15


def test_kernels_add_up_over_steps(monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 3)), rng.normal(size=500)
    chain, mapping = it.Affine.identity(3), it.fourier_map(3, 0.5, 16, 0)
    svr = (chain, mapping, rng.normal(size=17), 0.1, 0.2)
    hinge = (chain, None, rng.normal(size=4), 0.1, (1.0, 2.0))
    mlp = (chain, rng.normal(size=3 * 8 + 8 + 8 + 1), [3, 8, 1], "relu", 0.1, 2.0)
    whole = [k(x, y, p) for k, p in ((it._svr_kernel, svr), (it._hinge_kernel, hinge), (it._mlp_kernel, mlp))]
    monkeypatch.setattr(it, "STEP_VALUES", 100)
    for (k, p), want in zip(((it._svr_kernel, svr), (it._hinge_kernel, hinge), (it._mlp_kernel, mlp)), whole):
        assert k(x, y, p) == pytest.approx(want, rel=1e-9, abs=1e-9)
    f = np.column_stack([np.sqrt(2 / 16) * np.cos(x @ mapping[0] + mapping[1]), np.ones(500)])
    assert np.abs(it._expand(x, mapping) - f).max() < 1e-14
