import numpy as np
import pytest
from pyspark.sql import functions as F

from foldyard.operators import iterative as it
from foldyard.operators import sums as S
from foldyard.plans.dataset import Dataset
from foldyard.plans.engine import Engine
from foldyard.plans.experiments import Variant, expand


@pytest.fixture(scope="module")
def design(spark):
    fold = F.when(F.col("id") % 7 < 6, (F.col("id") % 3).cast("int"))  # some have no fold
    x = F.array(*[(F.col("id") * c % 97).cast("double") for c in (3, 5)])
    return spark.range(5000, numPartitions=3).select(fold.alias("fold"), (F.col("id") % 11).cast("double").alias("y"), x.alias("x"))


@pytest.mark.parametrize("per_fold", [False, True])
@pytest.mark.parametrize("rows", [16, 300, 100_000])
def test_blocks_add_up_to_the_sums_of_the_rows(design, monkeypatch, rows, per_fold):
    def total(x, y, param):
        return np.concatenate([[len(y), y.sum() * param], (x * y[:, None]).sum(0)])

    monkeypatch.setattr(S, "_block_rows", lambda width: rows)
    blocks = S.in_blocks(design)
    want = S.fold_sums(design, total, [1.0, 2.0, 3.0], 4, per_fold=per_fold)
    assert np.array_equal(S.fold_sums(blocks, total, [1.0, 2.0, 3.0], 4, per_fold=per_fold), want)
    sizes = [r[0] // 8 for r in blocks.select(F.length("y")).collect()]
    assert sum(sizes) == 5000 and max(sizes) <= rows


def test_iterative_fits_of_a_run_read_one_cached_table_of_blocks(spark, monkeypatch):
    """Before, every pass turned all rows into Arrow records and picked them by fold."""
    read = []
    whole = it.fold_sums
    monkeypatch.setattr(it, "fold_sums", lambda design, *a, **k: read.append(design) or whole(design, *a, **k))
    x, z = F.col("id") % 13, F.col("id") % 7
    rows = spark.range(400).select((F.col("id") % 3).alias("f"), x.alias("a"), z.alias("b"), (x * z).alias("y"))
    data = Dataset.build(rows, ["a", "b"], "y", "regression", "f")
    search = {
        "scale": {"enabled": ["none"]}, "filter": {"enabled": ["none"]},
        "reduction": {"enabled": ["none", "ica"]}, "model": {
            "enabled": ["svm", "mlp"],
            "params": {"mlp": {"max_iter": 3, "hidden_layer_sizes": [[2]]}, "svm": {"max_iter": 3, "kernel": "linear"}},
        },
    }
    detailed, failed = Engine(data, "regression", ["r2"]).run(expand("regression", {"search": search}))
    assert len(detailed) == 4 * 3 and not failed
    assert read and {d.schema["x"].dataType.simpleString() for d in read} == {"binary"}
    assert len({id(d) for d in read}) == 1 and not read[0].is_cached


def test_tree_fits_wait_where_their_rows_would_not_fit_together(spark):
    class Rows:
        rows, d = 0, 4

    data = type("Data", (), {"df": spark.range(1), "profile": Rows, "d": 4})
    engine = Engine(data, "regression", ["r2"], parallelism=4)
    forest, line = Variant("rf", {"n_estimators": 5}), Variant("mlp", {})
    for rows, models, fits in ((1000, [forest], 4), (10**10, [forest], 1), (10**10, [line], 4)):
        Rows.rows = rows
        assert engine._fits_at_once(models) == fits


def test_codes_stop_where_they_no_longer_change():
    rng = np.random.default_rng(3)
    x, h = rng.uniform(size=(200, 4)), rng.uniform(size=(2, 4))
    assert np.array_equal(it.nonnegative_codes(x, h, 10_000), it.nonnegative_codes(x, h, 400))
    w = it.nonnegative_codes(x, h, 400)
    slope = (w @ h - x) @ h.T
    assert (np.abs(np.minimum(slope, w)) < 1e-12).all() and (w >= 0).all()
