"""Spark ML estimators behind the model names of a search space."""

from __future__ import annotations

from typing import Any

from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

from ..errors import ModelExecutionError

SEED = 0
# Unlimited depth is not practical for distributed trees; Spark allows up to 30.
DEFAULT_DEPTH = 12
DEEPEST = 30


def _subset(max_features: Any) -> str:
    """A whole number is that many features, a fraction a share of them."""
    if max_features is None or isinstance(max_features, float) and max_features == 1.0:
        return "all"
    return max_features if isinstance(max_features, str) else str(max_features)


def _seed(params: dict) -> int:
    seed = params.get("random_state")
    return SEED if seed is None else int(seed)


def _trees(kind, params: dict, n_trees: int, features: Any, **extra):
    depth = params.get("max_depth")
    return kind(
        featuresCol="z",
        labelCol="y",
        numTrees=params.get("n_estimators", n_trees),
        maxDepth=DEFAULT_DEPTH if depth is None else depth,
        featureSubsetStrategy=_subset(params.get("max_features", features)),
        subsamplingRate=float(params.get("max_samples") or 1.0),
        bootstrap=bool(params.get("bootstrap", True)),
        minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
        minInfoGain=float(params.get("min_impurity_decrease", 0.0)),
        maxBins=int(params.get("max_bins", 32)),
        seed=_seed(params),
        **extra,
    )


def forest_regressor(params: dict):
    criterion = params.get("criterion", "squared_error")
    if criterion != "squared_error":
        raise ModelExecutionError(f"criterion {criterion!r} is not available")
    return _trees(RandomForestRegressor, params, 100, 1.0)


def bagging_regressor(params: dict):
    return _trees(RandomForestRegressor, params, 10, 1.0)


def forest_classifier(params: dict):
    criterion = params.get("criterion", "gini")
    impurity = "entropy" if criterion in ("entropy", "log_loss") else criterion
    return _trees(RandomForestClassifier, params, 100, "sqrt", impurity=impurity)


def bagging_classifier(params: dict):
    return _trees(RandomForestClassifier, params, 10, 1.0)


def boosted_regressor(params: dict):
    """Boosting starts from the mean: fit it on the target minus the training mean."""
    losses = {"squared_error": "squared", "absolute_error": "absolute"}
    loss = params.get("loss", "squared_error")
    if loss not in losses:
        raise ModelExecutionError(f"loss {loss!r} is not available")
    return GBTRegressor(
        featuresCol="z",
        labelCol="y",
        lossType=losses[loss],
        maxIter=params.get("n_estimators", 100),
        stepSize=float(params.get("learning_rate", 0.1)),
        maxDepth=params.get("max_depth", 3),
        subsamplingRate=float(params.get("subsample", 1.0)),
        minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
        maxBins=int(params.get("max_bins", 32)),
        seed=_seed(params),
    )


def class_weights(spec: Any, classes: list, n: Any) -> list[float] | None:
    """Weight of each class: None, ``balanced`` or label -> weight (1 where absent);
    ``n`` holds the training rows of each class."""
    if spec is None:
        return None
    if spec == "balanced":
        present = sum(1 for c in n if c)
        return [sum(n) / (present * c) if c else 0.0 for c in n]
    if not isinstance(spec, dict):
        raise ModelExecutionError(f"class_weight={spec!r} must be 'balanced' or a mapping of labels")
    named = {str(k): float(v) for k, v in spec.items()}
    unknown = set(named) - {str(c) for c in classes}
    if unknown:
        raise ModelExecutionError(f"class_weight names {sorted(unknown)}, which are no classes of the target")
    return [named.get(str(c), 1.0) for c in classes]


def logistic(params: dict, n_train: float):
    """``C * sum(loss) + |w|^2 / 2`` equals a mean loss with 1 / (C n) penalty."""
    inverse = float(params.get("C", 1.0))
    penalty = params.get("penalty", "l2")
    ratios = {"l2": 0.0, "l1": 1.0, "elasticnet": float(params.get("l1_ratio") or 0.0)}
    none = penalty in (None, "none")
    if inverse <= 0 or not (none or penalty in ratios):
        raise ModelExecutionError(f"C={inverse}, penalty={penalty!r} is not valid")
    return LogisticRegression(
        featuresCol="z",
        labelCol="y",
        regParam=0.0 if none else 1.0 / (inverse * n_train),
        elasticNetParam=0.0 if none else ratios[penalty],
        standardization=False,
        fitIntercept=bool(params.get("fit_intercept", True)),
        maxIter=int(params.get("max_iter", 100)),
        tol=float(params.get("tol", 1e-4)),
    )


def linear_svc(params: dict, n_train: float, n_classes: int):
    inverse = float(params.get("C", 1.0))
    if inverse <= 0:
        raise ModelExecutionError(f"C={inverse} must be positive")
    iterations = int(params.get("max_iter", -1))
    margin = LinearSVC(
        featuresCol="z",
        labelCol="y",
        regParam=1.0 / (inverse * n_train),
        standardization=False,
        maxIter=100 if iterations < 0 else iterations,
        tol=float(params.get("tol", 1e-3)),
    )
    if n_classes == 2:
        return margin
    return OneVsRest(classifier=margin, featuresCol="z", labelCol="y")
