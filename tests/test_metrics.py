import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldyard.errors import ConfigDataError
from foldyard.functions import metrics as M
from foldyard.operators import order_stats


def _frame(spark, **columns):
    pdf = pd.DataFrame({"experiment_id": 1, **columns})
    rows = [tuple(r) for r in pdf.itertuples(index=False)]
    types = ", ".join(
        f"{c} {'int' if c in M.KEYS else 'double'}" for c in pdf.columns
    )
    rows = [
        tuple(int(v) if c in M.KEYS else float(v) for c, v in zip(pdf.columns, r)) for r in rows
    ]
    return spark.createDataFrame(rows, types).repartition(4)


def test_regression_scores(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "FETCH_ROWS", 10)
    rng = np.random.default_rng(0)
    fold = rng.integers(0, 3, 501)
    y, p = rng.gamma(2, size=501), rng.gamma(2, size=501)
    got = M.scores("regression", _frame(spark, fold=fold, y=y, p=p), list(M.REGRESSION_METRICS))
    for row in got.collect():
        a, b = y[fold == row["fold"]], p[fold == row["fold"]]
        r = a - b
        gap = np.log1p(a) - np.log1p(b)
        expected = {
            "neg_root_mean_squared_error": -np.sqrt((r**2).mean()),
            "neg_mean_squared_error": -(r**2).mean(),
            "r2": 1 - (r**2).sum() / ((a - a.mean()) ** 2).sum(),
            "neg_mean_absolute_error": -np.abs(r).mean(),
            "neg_median_absolute_error": -np.median(np.abs(r)),
            "explained_variance": 1 - r.var() / a.var(),
            "max_error": -np.abs(r).max(),
            "neg_max_error": -np.abs(r).max(),
            "neg_mean_absolute_percentage_error": -(np.abs(r) / np.abs(a)).mean(),
            "neg_mean_squared_log_error": -(gap**2).mean(),
            "neg_root_mean_squared_log_error": -np.sqrt((gap**2).mean()),
        }
        for name, value in expected.items():
            assert row[name] == pytest.approx(value, rel=1e-9), name


def test_r2_of_a_constant_target_and_of_one_row(spark):
    frame = _frame(spark, fold=[0, 0, 1, 1, 2], y=[2, 2, 2, 2, 5], p=[2, 2, 1, 3, 5])
    got = {r["fold"]: r["r2"] for r in M.regression_scores(frame, ["r2"]).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: None}


def _auc(y, s):
    order = pd.Series(s).rank().to_numpy()
    pos = (y == 1).sum()
    return (order[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def _average_precision(y, s):
    total, before = 0.0, 0.0
    for cut in np.unique(s)[::-1]:
        hit = s >= cut
        recall = (y[hit] == 1).sum() / (y == 1).sum()
        total += (recall - before) * (y[hit] == 1).mean()
        before = recall
    return total


def test_binary_scores_with_a_score_shared_by_a_third_of_the_rows(spark):
    rng = np.random.default_rng(1)
    n = 600
    fold, y = rng.integers(0, 2, n), rng.integers(0, 2, n)
    s = np.where(rng.random(n) < 0.35, 0.5, np.round(rng.normal(size=n) + y, 2))
    p, p_true = (s > 0.6).astype(int), rng.uniform(0.05, 1, n)
    one = np.where(y == 1, p_true, 1 - p_true)  # the probability of class 1
    frame = _frame(spark, fold=fold, y=y, p=p, score=s, p_true=p_true, one=one)
    frame = frame.withColumn("probs", F.array(1 - F.col("one"), F.col("one")))
    got = M.scores("classification", frame, list(M.CLASSIFICATION_METRICS)).collect()
    for row in got:
        at = fold == row["fold"]
        a, b = y[at], p[at]
        tp, fp = ((a == 1) & (b == 1)).sum(), ((a == 0) & (b == 1)).sum()
        fn, tn = ((a == 1) & (b == 0)).sum(), ((a == 0) & (b == 0)).sum()
        f1 = [2 * tp / (2 * tp + fp + fn), 2 * tn / (2 * tn + fp + fn)]
        expected = {
            "roc_auc": _auc(a, s[at]),
            "average_precision": _average_precision(a, s[at]),
            "neg_log_loss": np.log(p_true[at]).mean(),
            "neg_brier_score": -((one[at] - a) ** 2).mean(),
            "top_k_accuracy": 1.0,
            **{m: _auc(a, one[at]) for m in M.PAIR_METRICS},
            "accuracy": (a == b).mean(),
            "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2,
            "precision": tp / (tp + fp),
            "recall": tp / (tp + fn),
            "f1": f1[0],
            "jaccard": tp / (tp + fp + fn),
            "f1_macro": np.mean(f1),
            "f1_micro": (a == b).mean(),
            "f1_weighted": np.average(f1, weights=[(a == 1).sum(), (a == 0).sum()]),
            "matthews_corrcoef": (tp * tn - fp * fn)
            / np.sqrt(float((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        }
        for name, value in expected.items():
            assert row[name] == pytest.approx(value, rel=1e-9), name


@pytest.mark.parametrize("ranges", [(2, 4), (16, 1024)])
def test_areas_of_three_classes(spark, monkeypatch, ranges):
    """Each class against the rest and against each other, from the definitions; a fold
    that lacks a class has no area."""
    monkeypatch.setattr(M, "SCORE_RANGES", ranges)
    rng = np.random.default_rng(4)
    fold, y = rng.integers(0, 3, 400), rng.integers(0, 3, 400)
    y[(fold == 2) & (y == 1)] = 0
    raw = rng.integers(1, 6, (400, 3)) + 2 * np.eye(3)[y]  # ties
    probs = raw / raw.sum(1, keepdims=True)
    frame = _frame(spark, fold=fold, y=y, a=probs[:, 0], b=probs[:, 1], c=probs[:, 2])
    frame = frame.withColumn("probs", F.array("a", "b", "c"))
    for row in M.classification_scores(frame, [*M.PAIR_METRICS, "top_k_accuracy", "neg_brier_score"]).collect():
        at = fold == row["fold"]
        t, p = y[at], probs[at]
        if row["fold"] == 2:
            assert all(row[m] is None for m in M.PAIR_METRICS)
            continue
        rest = [_auc((t == c).astype(int), p[:, c]) for c in range(3)]
        pairs, sizes = [], []
        for i, j in ((0, 1), (0, 2), (1, 2)):
            two = (t == i) | (t == j)
            sides = [_auc((t[two] == x).astype(int), p[two, x]) for x in (i, j)]
            pairs.append(np.mean(sides))
            sizes.append(two.sum())
        assert row["roc_auc_ovr"] == pytest.approx(np.mean(rest))
        assert row["roc_auc_ovr_weighted"] == pytest.approx(np.average(rest, weights=np.bincount(t)))
        assert row["roc_auc_ovo"] == pytest.approx(np.mean(pairs))
        assert row["roc_auc_ovo_weighted"] == pytest.approx(np.average(pairs, weights=sizes))
        assert row["neg_brier_score"] == pytest.approx(-((p - np.eye(3)[t]) ** 2).sum(1).mean())
        order = np.argsort(p, axis=1, kind="stable")[:, ::-1][:, :2]
        assert row["top_k_accuracy"] == pytest.approx((order == t[:, None]).any(1).mean())


def test_labels_only_predicted_count_as_zero(spark):
    frame = _frame(spark, fold=[0] * 4, y=[0, 0, 1, 1], p=[0, 2, 1, 1])
    row = M.classification_scores(frame, ["f1_macro", "precision_macro", "recall_macro"]).first()
    assert row["f1_macro"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert row["recall_macro"] == pytest.approx((0.5 + 1 + 0) / 3)


def test_unknown_metric_is_rejected():
    with pytest.raises(ConfigDataError, match="Unknown regression metrics"):
        M.check_metrics("regression", ["accuracy"])
