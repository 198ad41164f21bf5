"""Techniques by step and task, with the parameters each understands."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from ..errors import ConfigDataError

STEPS = ("scale", "filter", "reduction", "model")

# Technique names and parameter names users write in a search space.
# Parameters listed in NO_EFFECT only steer single-machine execution.
NO_EFFECT = {"n_jobs", "verbose", "copy", "copy_X", "warm_start", "cache_size", "solver"}
_FOREST = {
    "n_estimators", "max_depth", "max_features", "min_samples_leaf", "max_samples",
    "bootstrap", "min_impurity_decrease", "random_state", "max_bins",
}
_BAGGING = {"n_estimators", "max_depth", "max_samples", "max_features", "bootstrap", "random_state", "max_bins"}
_SCALE = {"none": None, "norm": {"norm"}, "std": {"with_mean", "with_std"}}
_REDUCTION = {
    "none": None,
    "pca": {"n_components", "whiten", "random_state", "svd_solver"},
    "ica": {"n_components", "fun", "max_iter", "tol", "random_state", "algorithm", "whiten"},
    "nmf": {"n_components", "max_iter", "tol", "random_state", "init"},
}
TECHNIQUES = {
    "regression": {
        "scale": _SCALE,
        "filter": {"none": None, "fscore": {"percentile"}, "mi": {"percentile"}},
        "reduction": _REDUCTION,
        "model": {
            "pls": {"n_components", "scale", "max_iter", "tol"},
            "sgd": {"loss", "penalty", "alpha", "l1_ratio", "epsilon", "max_iter", "tol", "random_state"},
            "svm": {"kernel", "C", "epsilon", "gamma", "tol", "max_iter", "random_state", "n_features"},
            "bag": _BAGGING,
            "gbr": {
                "n_estimators", "learning_rate", "max_depth", "subsample", "min_samples_leaf",
                "random_state", "loss", "max_bins",
            },
            "rf": _FOREST | {"criterion"},
            "mlp": {
                "hidden_layer_sizes", "activation", "alpha", "learning_rate_init", "max_iter",
                "tol", "n_iter_no_change", "random_state",
            },
        },
    },
    "classification": {
        "scale": _SCALE,
        "filter": {"none": None, "fscore": {"percentile"}},
        "reduction": _REDUCTION,
        "model": {
            "logreg": {
                "C", "penalty", "l1_ratio", "max_iter", "tol", "fit_intercept", "random_state", "class_weight",
            },
            "svc": {
                "kernel", "C", "gamma", "max_iter", "tol", "random_state", "n_features", "class_weight", "probability",
            },
            "rfc": _FOREST | {"criterion", "class_weight"},
            "bagc": _BAGGING,
        },
    },
}

# Relative cost of one technique, and of one the table does not know.
COST = {
    "model": {
        "pls": 1.0, "sgd": 1.1, "svm": 2.2, "bag": 1.7, "gbr": 2.0, "rf": 2.4, "mlp": 2.8,
        "logreg": 1.2, "svc": 2.3, "rfc": 2.5, "bagc": 1.8,
    },
    "reduction": {"none": 1.0, "pca": 1.15, "ica": 1.35, "nmf": 1.4},
    "scale": {"none": 1.0, "norm": 1.02, "std": 1.04},
    "filter": {"none": 1.0, "fscore": 1.05, "mi": 1.2},
}
UNKNOWN_COST = {"model": 1.5, "reduction": 1.1, "scale": 1.02, "filter": 1.03}


#: Techniques that users have added: (task, step, key) -> builder.
ADDED: dict[tuple[str, str, str], Callable] = {}
ANY = frozenset({"*"})


def register(
    task: str, step: str, key: str, builder: Callable, parameters: Iterable[str] | None = None, cost: float | None = None
) -> None:
    """Add a technique to a step of a task's search space, for the whole program.

    A model's builder takes its parameters and returns a Spark ML estimator that reads
    ``z`` (vector) and ``y`` and writes ``prediction``; its training rows and test rows
    are those of any other model. The builder of an earlier step takes the ``Moments`` of
    the training rows of one fold model, and its parameters, and returns the ``Affine``
    map that the step is. ``parameters`` are the names a search may set (None: any),
    ``cost`` the weight in plans.
    """
    if task not in TECHNIQUES or step not in STEPS:
        raise ConfigDataError(f"Techniques belong to a task and one of {STEPS}, not {task!r}, {step!r}")
    known = TECHNIQUES[task][step]
    if key in known and (task, step, key) not in ADDED:
        raise ConfigDataError(f"{step} technique {key!r} exists already")
    TECHNIQUES[task][step] = {**known, key: ANY if parameters is None else set(parameters)}
    ADDED[task, step, key] = builder
    if cost is not None:
        COST[step][key] = float(cost)


def added(task: str, step: str, key: str) -> Callable[..., Any] | None:
    return ADDED.get((task, step, key))


def check_technique(task: str, step: str, key: str, params: dict) -> None:
    """Unknown names are rejected before any job; bad values fail their combination."""
    known = TECHNIQUES[task][step]
    if key not in known:
        raise ConfigDataError(f"Unknown {step} technique: {key}")
    if known[key] is None or known[key] == ANY:
        return
    unknown = set(params) - known[key] - NO_EFFECT
    if unknown:
        raise ConfigDataError(f"Unknown parameters for {step} '{key}': {sorted(unknown)}")
