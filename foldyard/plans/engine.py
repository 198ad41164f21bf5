"""Cross-validated execution of all experiments.

Steps before the model are fitted once per (scale, filter, reduction) prefix for all
folds together, mostly from one shared pass of per-fold moments. Models with a closed
form need no further pass to fit, and all of them are scored in one pass. Spark ML
models are fitted per fold on filters of the one cached table, a few fits at a time.
Regression trees of few features are grown on cells of their bins instead.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import reduce
from typing import Any, Callable

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..errors import ModelExecutionError
from ..functions import metrics as M
from ..operators import cells as ce
from ..operators import iterative as it
from ..operators import mllib
from ..operators.features import (
    Affine,
    f_scores_classes,
    f_scores_regression,
    keep_percentile,
    own_fold_columns,
    principal_axes,
    standardise,
    take,
)
from ..operators.linear import penalised_least_squares, pls
from ..operators.moments import Moments
from ..operators.mutual_info import train_mutual_info
from ..operators.sums import apply_rows, in_blocks, out_of_fold
from ..session import materialize
from .dataset import Dataset
from .experiments import Experiment, Variant
from .registry import NO_EFFECT, added

SCORED_TOGETHER = 16
WIDE_MAP = 256  # matrix entries up to which a linear map is written as columns
FIXED_SEED = 0
NEWTON_FEATURES = 1024  # columns up to which the curvature of all folds is summed in tasks
#: Bytes that Spark ML caches of a training row of trees, beside 4 a feature and tree.
TREE_ROW = 128
TREE_COUNTS = {"rf": 100, "bag": 10, "rfc": 100, "bagc": 10, "gbr": 1}  # by default; boosting bags one by one
#: What a fit or a score may raise for its parameters or data; anything else is a fault
#: of the program or the session and ends the run.
MODEL_ERRORS = (ModelExecutionError, ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException)


def _used(params: dict[str, Any], *drop: str) -> dict[str, Any]:
    return {k: v for k, v in params.items() if k not in NO_EFFECT and k not in drop}


@dataclass
class Prefix:
    """Fitted steps before the model: an affine map per fold model, then NMF codes."""

    base: Dataset
    chain: list[Affine]
    moments: list[Moments]  # of the features the model sees, on its training rows
    bases: list[np.ndarray] | None = None

    def vectors(self, m: int) -> DataFrame:
        """(fold, y, z vector) as fold model m sees all rows."""
        chain = self.chain[m]
        if self.bases is None and (chain.is_identity or chain.weights.size <= WIDE_MAP):
            columns = [F.col(c) for c in self.base.names]
            if not chain.is_identity:
                columns = chain.columns(columns)
            z = F.array(*columns)
            return self.base.df.select("fold", "y", array_to_vector(z).alias("z"))
        if self.bases is None:
            moved = apply_rows(self.base.design, mapped, chain)
        else:
            moved = apply_rows(self.base.design, codes_of, (chain, self.bases[m]))
        return moved.select("fold", "y", array_to_vector("x").alias("z"))

    def design_for(self, m: int) -> DataFrame:
        """Design table of fold model m alone: test rows in fold 0, the rest in 1."""
        moved = apply_rows(self.base.design, codes_of, (self.chain[m], self.bases[m]))
        return moved.withColumn("fold", (F.col("fold") != m).cast("int"))


def mapped(x: np.ndarray, chain: Affine) -> np.ndarray:
    return chain.apply(x)


def codes_of(x: np.ndarray, param) -> np.ndarray:
    chain, basis = param
    return it.nonnegative_codes(chain.apply(x), basis)


def linear_of_codes(x: np.ndarray, param) -> np.ndarray:
    chain, basis, beta, intercept = param
    return it.nonnegative_codes(chain.apply(x), basis) @ beta + intercept


class Engine:
    """Fits and scores experiments on one dataset."""

    def __init__(self, dataset: Dataset, task: str, metrics: list[str], parallelism: int = 4):
        self.dataset = dataset
        self.task = task
        self.metrics = metrics
        self.parallelism = parallelism
        self.spark = dataset.df.sparkSession
        self._bases: dict[Any, Dataset] = {}
        self._scores: dict[Any, np.ndarray] = {}
        self._prefixes: dict[Any, Prefix | Exception] = {}
        self._cuts: dict[Any, list | None] = {}

    # -- steps before the model ------------------------------------------------------

    def base(self, scale: Variant) -> Dataset:
        norm = scale.params.get("norm", "l2") if scale.key == "norm" else None
        if norm not in self._bases:
            self._bases[norm] = self.dataset if norm is None else self.dataset.normalised(norm)
        return self._bases[norm]

    def filter_scores(self, base: Dataset, key: str) -> np.ndarray:
        """Per fold model and feature. F scores and bin ranks do not change when a
        column is rescaled, so they are taken before standardisation."""
        at = (id(base), key)
        if at not in self._scores:
            if key == "mi":
                scores = train_mutual_info(base.df, base.names, "y", base.k)
            elif self.task == "regression":
                scores = np.stack([f_scores_regression(m) for m in base.train_moments])
            else:
                n, sums = base.class_statistics
                centre = base.profile.mean[:-1]
                scores = []
                for m, moments in enumerate(base.train_moments):
                    class_n = n.sum(axis=0) - n[m]
                    shift = (moments.x_mean - centre) * class_n[:, None]
                    class_sums = sums.sum(axis=0) - sums[m] - shift
                    scores.append(f_scores_classes(moments, class_n, class_sums))
                scores = np.stack(scores)
            self._scores[at] = scores
        return self._scores[at]

    def _fit_prefix(self, scale: Variant, filt: Variant, reduction: Variant) -> Prefix:
        base = self.base(scale)
        chain = [Affine.identity(base.d)] * base.k
        moments = list(base.train_moments)

        def advance(steps: list[Affine]) -> None:
            nonlocal chain, moments
            chain = [c.then(s) for c, s in zip(chain, steps)]
            moments = [m.mapped(s.weights, s.offset) for m, s in zip(moments, steps)]

        def advance_added(step: str, chosen: Variant) -> bool:
            builder = added(self.task, step, chosen.key)
            if builder:
                advance([builder(m, **chosen.params) for m in moments])
            return builder is not None

        if scale.key == "std":
            params = _used(scale.params)
            advance([standardise(m, **params) for m in moments])
        else:
            advance_added("scale", scale)
        if filt.key != "none" and not advance_added("filter", filt):
            percentile = filt.params.get("percentile", 10)
            scores = self.filter_scores(base, filt.key)
            kept = [keep_percentile(s, percentile) for s in scores]
            if not all(len(keep) for keep in kept):
                raise ModelExecutionError("the filter keeps no feature")
            advance([take(keep, base.d) for keep in kept])
        advance_added("reduction", reduction)
        params = _used(reduction.params, "svd_solver", "algorithm", "init")
        if reduction.key == "pca":
            params.pop("random_state", None)
            advance([principal_axes(m, **params) for m in moments])
        elif reduction.key == "ica":
            params.pop("whiten", None)
            advance(it.fit_ica(base.blocks, moments, chain, **params))
        elif reduction.key == "nmf":
            params.pop("random_state", None)
            bases, _ = it.fit_nmf(base.blocks, moments, chain, **params)
            codes = it.code_moments(base.blocks, chain, bases, base.profile.mean[-1])
            return Prefix(base, chain, codes, bases)
        return Prefix(base, chain, moments)

    def prefix(self, experiment: Experiment) -> Prefix:
        key = experiment.row()[1:7]
        if key not in self._prefixes:
            try:
                self._prefixes[key] = self._fit_prefix(
                    experiment.scale, experiment.filter, experiment.reduction
                )
            except MODEL_ERRORS as exc:  # fails the combinations that use the fit
                self._prefixes[key] = exc
        found = self._prefixes[key]
        if isinstance(found, Exception):
            raise found
        return found

    # -- models ----------------------------------------------------------------------

    def _linear(self, prefix: Prefix, model: Variant) -> list[tuple[np.ndarray, float]] | None:
        """(weights, intercept) on the model's features per fold, if it is linear."""
        params = _used(model.params, "random_state")
        if model.key == "pls":
            kept = {k: v for k, v in params.items() if k == "n_components"}
            scale = model.params.get("scale", True)
            return [pls(m, scale=scale, **kept) for m in prefix.moments]
        if model.key != "sgd":
            return None
        loss, penalty = params.get("loss", "squared_error"), params.get("penalty", "l2")
        alpha = float(params.get("alpha", 1e-4))
        ratios = {"l2": 0.0, "l1": 1.0, "elasticnet": float(params.get("l1_ratio", 0.15)), None: 0.0}
        if penalty not in ratios or alpha < 0:
            raise ModelExecutionError(f"penalty={penalty!r}, alpha={alpha} is not valid")
        alpha = 0.0 if penalty is None else alpha
        if loss == "squared_error":
            return [penalised_least_squares(m, alpha, ratios[penalty]) for m in prefix.moments]
        robust = ("huber", "epsilon_insensitive", "squared_epsilon_insensitive")
        if loss not in robust or ratios[penalty]:
            raise ModelExecutionError(f"loss={loss!r} with penalty={penalty!r} is not available")
        epsilon = float(params.get("epsilon", 0.1))

        def fit(design, moments, chain):
            return it.fit_robust_linear(design, moments, chain, loss, alpha, epsilon)

        return self._fit_all(prefix, fit)

    def _fit_all(self, prefix: Prefix, fit: Callable) -> list:
        """Fit an iterative model for all folds: at once, or per fold on NMF codes."""
        if prefix.bases is None:
            return fit(prefix.base.blocks, prefix.moments, prefix.chain)
        found = []
        for m, moments in enumerate(prefix.moments):
            design = in_blocks(prefix.design_for(m)).persist(StorageLevel.MEMORY_AND_DISK)
            identity = Affine.identity(len(moments.x_mean))
            found += fit(design, [moments], [identity])
            design.unpersist()
        return found

    def _predict_iterative(self, prefix: Prefix, model: Variant) -> DataFrame:
        params = _used(model.params)
        if model.key == "svm":
            fit, predict = it.fit_svr, it.predict_svr
            if params.get("max_iter", 1) == -1:
                params.pop("max_iter")
        else:
            fit, predict = it.fit_mlp, it.predict_mlp
        fitted = self._fit_all(prefix, lambda d, m, c: fit(d, m, c, **params))
        if prefix.bases is None:
            scored = out_of_fold(prefix.base.design, predict, fitted)
        else:
            stacked = [(c, b, p, predict) for c, b, p in zip(prefix.chain, prefix.bases, fitted)]
            scored = out_of_fold(prefix.base.design, predict_on_codes, stacked)
        return scored.select("fold", "y", F.get("z", F.lit(0)).alias("p"))

    def _own_weights(self, model: Variant, m: int) -> list[float] | None:
        """Class weights of fold model m, from its training rows."""
        n, _ = self.dataset.class_statistics
        return mllib.class_weights(model.params.get("class_weight"), self.dataset.classes, n.sum(axis=0) - n[m])

    def _solved_here(self, model: Variant) -> bool:
        """Two classes and a smooth or reweighted loss: all folds share each pass."""
        two = len(self.dataset.classes) == 2
        if model.key == "logreg":
            narrow = self.dataset.d <= NEWTON_FEATURES
            return two and narrow and model.params.get("penalty", "l2") in ("l2", "none", None)
        return two and model.key == "svc"

    def _predict_two_classes(self, prefix: Prefix, model: Variant) -> DataFrame:
        params = _used(model.params, "class_weight", "l1_ratio")
        if model.key == "logreg":
            fit, params = it.fit_logistic, {k: v for k, v in params.items() if k != "random_state"}
            params["penalty"] = None if params.get("penalty", "l2") == "none" else params.get("penalty", "l2")
            if float(params.get("C", 1.0)) <= 0:
                raise ModelExecutionError(f"C={params['C']} must be positive")
        else:
            fit = it.fit_svc
            asked = "neg_log_loss" in self.metrics or self._wants_probs()
            params["probability"] = bool(params.get("probability")) or asked
            if params.get("max_iter", 1) == -1:
                params.pop("max_iter")
        for m in range(self.dataset.k):
            self._check_classes(model, m)
        weights = [self._own_weights(model, m) for m in range(self.dataset.k)]
        own = None if weights[0] is None else [tuple(w) for w in weights]
        at = iter(range(self.dataset.k))

        def fold_fit(design, moments, chain):
            picked = own if own is None or len(moments) == len(own) else [own[next(at)]]
            return fit(design, moments, chain, class_weights=picked, **params)

        fitted = self._fit_all(prefix, fold_fit)
        predict = it.predict_two_classes
        if prefix.bases is None:
            scored = out_of_fold(prefix.base.design, predict, fitted)
        else:
            stacked = [(c, b, p, predict) for c, b, p in zip(prefix.chain, prefix.bases, fitted)]
            scored = out_of_fold(prefix.base.design, predict_on_codes, stacked)
        margin, p1 = F.get("z", F.lit(0)), F.nanvl(F.get("z", F.lit(1)), F.lit(None).cast("double"))
        return scored.select(
            "fold", "y", (margin > 0).cast("double").alias("p"), margin.alias("score"),
            F.when(F.col("y") > 0, p1).otherwise(1 - p1).alias("p_true"),
            *([F.when(p1.isNotNull(), F.array(1 - p1, p1)).alias("probs")] if self._wants_probs() else []),
        )

    def _predict_mllib(
        self, prefix: Prefix, model: Variant, m: int, held: list[DataFrame]
    ) -> DataFrame:
        params = model.params
        table = prefix.vectors(m)
        if prefix.bases is not None or prefix.chain[m].weights.size > WIDE_MAP:
            table = table.persist()  # costly features; released once scored
            held.append(table)
        train = table.where(F.col("fold") != m)
        test = table.where(F.col("fold") == m)
        n_train = prefix.moments[m].n
        offset = 0.0
        if self.task == "classification":
            self._check_classes(model, m)
        if model.key == "svc" and params.get("kernel", "rbf") == "rbf":
            gamma = it.kernel_width(params.get("gamma", "scale"), prefix.moments[m])
            seed = params.get("random_state")
            mapping = it.fourier_map(
                len(prefix.moments[m].x_mean), gamma,
                params.get("n_features", it.FOURIER_FEATURES),
                FIXED_SEED if seed is None else seed,
            )
            train, test = (fourier_vectors(part, mapping) for part in (train, test))
        if model.key == "gbr":
            offset = prefix.moments[m].y_mean
            train = train.withColumn("y", F.col("y") - F.lit(offset))
        weights = self._own_weights(model, m) if model.key in ("logreg", "svc", "rfc") else None
        if weights is not None:
            row_weight = F.get(F.array(*map(F.lit, weights)), F.col("y").cast("int"))
            train = train.withColumn("row_weight", row_weight)
        builder = added(self.task, "model", model.key)
        estimator = builder(**params) if builder else {
            "rf": lambda: mllib.forest_regressor(params),
            "bag": lambda: mllib.bagging_regressor(params),
            "gbr": lambda: mllib.boosted_regressor(params),
            "rfc": lambda: mllib.forest_classifier(params),
            "bagc": lambda: mllib.bagging_classifier(params),
            "logreg": lambda: mllib.logistic(params, n_train),
            "svc": lambda: mllib.linear_svc(params, n_train, len(self.dataset.classes)),
        }[model.key]()
        if weights is not None:
            if model.key == "svc":
                raise ModelExecutionError("class_weight of svc needs a two-class target")
            estimator.setWeightCol("row_weight")
        scored = estimator.fit(train).transform(test)
        p = F.col("prediction") + F.lit(offset)
        if self.task == "regression":
            return scored.select("fold", "y", p.alias("p"))
        raw = F.get(vector_to_array("rawPrediction"), F.lit(1))
        has_probability = "probability" in scored.columns
        probability = (
            F.get(vector_to_array("probability"), F.col("y").cast("int"))
            if has_probability
            else F.lit(None).cast("double")
        )
        probs = vector_to_array("probability") if has_probability else F.lit(None).cast("array<double>")
        return scored.select(
            "fold", "y", p.alias("p"), raw.alias("score"), probability.alias("p_true"),
            *([probs.alias("probs")] if self._wants_probs() else []),
        )

    def _own_cuts(self, prefix: Prefix, model: Variant, m: int) -> tuple[list[str], list[list[float]]] | None:
        """The columns that trees of fold model m see and where these are cut, if such
        trees can be grown on cells: squared errors, every column in every node, each a
        line of one feature, and few enough places."""
        params = model.params
        plain = {
            "gbr": params.get("loss", "squared_error") == "squared_error" and float(params.get("subsample", 1.0)) == 1.0,
            "rf": mllib._subset(params.get("max_features", 1.0)) == "all",
            "bag": mllib._subset(params.get("max_features", 1.0)) == "all",
        }
        if self.task != "regression" or prefix.bases is not None or added(self.task, "model", model.key):
            return None
        bins = params.get("max_bins", 32)
        kept = ce.axes(prefix.chain[m])
        if not plain.get(model.key) or kept is None or not isinstance(bins, int) or bins < 2:
            return None
        key = id(prefix.base), bins
        if key not in self._cuts:
            self._cuts[key] = ce.train_cuts(prefix.base.df, prefix.base.names, prefix.base.k, bins)
        if self._cuts[key] is None:
            return None
        own = [self._cuts[key][m][i] for i in kept]
        return ([prefix.base.names[i] for i in kept], own) if ce.places(own) <= ce.CELLS else None

    def _on_cells(self, prefix: Prefix, model: Variant) -> bool:
        return all(self._own_cuts(prefix, model, m) for m in range(self.dataset.k))

    def _predict_on_cells(self, prefix: Prefix, model: Variant, m: int) -> DataFrame:
        """Trees of fold model m, as the predictions at its cells; targets are taken from
        the training mean, so that sums of squares keep their digits."""
        params = model.params
        kind = {"rf": mllib.forest_regressor, "bag": mllib.bagging_regressor, "gbr": mllib.boosted_regressor}
        trees = kind[model.key](params)  # refuses bad values
        offset = prefix.moments[m].y_mean
        if prefix.moments[m].n < 1:
            raise ModelExecutionError("no training rows")
        names, cuts = self._own_cuts(prefix, model, m)
        table = ce.with_cell(prefix.base.df, names, cuts)
        is_train = F.coalesce(F.col("fold") != m, F.lit(False))
        rows = table.select("cell", (F.col("y") - F.lit(offset)).alias("y"), is_train.alias("train"))
        depth, least = trees.getMaxDepth(), trees.getMinInstancesPerNode()
        if depth > mllib.DEEPEST:
            raise ModelExecutionError(f"max_depth={depth} must be at most {mllib.DEEPEST}")
        if model.key == "gbr":
            grown = ce.boosted(rows, cuts, trees.getMaxIter(), trees.getStepSize(), depth, least)
        else:
            parts = max(self.spark.sparkContext.defaultParallelism, self.dataset.profile.rows // ce.CHUNK + 1)
            grown = ce.forest(
                rows, cuts, trees.getNumTrees(), trees.getSubsamplingRate(), trees.getBootstrap(), depth, least,
                trees.getMinInfoGain(), trees.getSeed(), parts,
            )
        found = F.broadcast(materialize(grown))  # CELLS rows at most
        test = table.where(F.col("fold") == m).join(found, "cell")
        return test.select("fold", "y", (F.col("p") + F.lit(offset)).alias("p"))

    def _wants_probs(self) -> bool:
        return any(m in M.PROBABILITY_METRICS for m in self.metrics)

    def _check_classes(self, model: Variant, m: int) -> None:
        n, _ = self.dataset.class_statistics
        if model.key in ("logreg", "svc") and ((n.sum(axis=0) - n[m]) > 0).sum() < 2:
            raise ModelExecutionError(f"{model.key} needs two classes in the training rows")
        if len(self.dataset.classes) != 2:
            binary = [x for x in self.metrics if x in M.BINARY_ONLY]
            if binary:
                raise ModelExecutionError(f"{binary} need a two-class target")
        elif 1 not in self.dataset.classes and set(self.metrics) & set(M.COUNT_BASES):
            raise ModelExecutionError("pos_label=1 is not a class of the target")
        needed = [x for x in self.metrics if x == "neg_log_loss" or x in M.PROBABILITY_METRICS]
        if needed and model.key == "svc" and len(self.dataset.classes) != 2:
            raise ModelExecutionError(f"{needed} need probabilities; svc gives those of two classes only")

    # -- running ---------------------------------------------------------------------

    def _score(self, predictions: DataFrame) -> dict[int, list[dict]]:
        """Rows of fold scores by experiment, in fold order."""
        found: dict[int, list[dict]] = {}
        several = M.passes(self.task, self.metrics) > 1
        if several:
            predictions = predictions.persist(StorageLevel.MEMORY_AND_DISK)
        if self.task == "classification":
            positive = self.dataset.classes.index(1) if 1 in self.dataset.classes else 1
            scored = M.classification_scores(predictions, self.metrics, positive)
        else:
            scored = M.regression_scores(predictions, self.metrics)
        for row in scored.collect():  # experiments x folds rows
            found.setdefault(row["experiment_id"], []).append(row.asDict())
        if several:
            predictions.unpersist()
        return {e: sorted(rows, key=lambda r: r["fold"]) for e, rows in found.items()}

    def _score_linear(self, base: Dataset, models: list[tuple[int, list[Affine]]]) -> dict:
        """Score many linear models of one base in one pass: every row is predicted
        by the coefficients of its own fold."""
        found: dict[int, list[dict]] = {}
        for start in range(0, len(models), SCORED_TOGETHER):
            structs = [
                F.struct(
                    F.lit(experiment_id).alias("experiment_id"),
                    own_fold_columns(maps, base.names)[0].alias("p"),
                )
                for experiment_id, maps in models[start : start + SCORED_TOGETHER]
            ]
            predictions = base.df.select("fold", "y", F.inline(F.array(*structs)))
            found.update(self._score(predictions))
        return found

    def _start(self, pool: ThreadPoolExecutor, experiment: Experiment, prefix: Prefix, label: str):
        """Submit the fits of one experiment: (futures of predictions, cached tables)."""
        model, held = experiment.model, []

        def described(function: Callable, *args) -> DataFrame:
            self.spark.sparkContext.setJobDescription(label)
            return function(*args)

        submit = inheritable_thread_target(self.spark)(described)
        solved = self.task == "classification" and self._solved_here(model)
        if prefix.bases is None and (solved or model.key in ("svm", "mlp")):
            prefix.base.blocks  # noqa: B018  (here, so that threads share one table)
        if solved:
            return [pool.submit(submit, self._predict_two_classes, prefix, model)], held
        if model.key in ("svm", "mlp"):
            return [pool.submit(submit, self._predict_iterative, prefix, model)], held
        if self._on_cells(prefix, model):
            return [pool.submit(submit, self._predict_on_cells, prefix, model, m) for m in range(self.dataset.k)], held
        return [
            pool.submit(submit, self._predict_mllib, prefix, model, m, held)
            for m in range(self.dataset.k)
        ], held

    def _fits_at_once(self, models: list[Variant]) -> int:
        """``parallelism``, or fewer where the cached rows of that many tree fits would
        fill over half of the executors' storage and spill each other."""
        trees = [
            1 if m.key == "gbr" else int(m.params.get("n_estimators", TREE_COUNTS[m.key]))
            for m in models if m.key in TREE_COUNTS
        ]
        if not trees:
            return max(1, self.parallelism)
        stores = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
        storage = 0
        while stores.hasNext():
            storage += stores.next()._1()
        fit = self.dataset.profile.rows * (TREE_ROW + 4 * (self.dataset.d + max(trees)))
        return max(1, min(self.parallelism, storage // 2 // max(fit, 1)))

    def _finish(self, experiment: Experiment, futures: list, held: list[DataFrame]) -> list[dict]:
        """Score the predictions of all folds in one job."""
        try:
            predictions = reduce(DataFrame.unionByName, [f.result() for f in futures])
            tagged = predictions.withColumn("experiment_id", F.lit(experiment.experiment_id))
            return self._score(tagged)[experiment.experiment_id]
        finally:
            wait(futures)
            for table in held:
                table.unpersist()

    def run(self, experiments: list[Experiment]) -> tuple[list[dict], list[dict]]:
        """(detailed rows, failed rows). A combination is in exactly one of them."""
        try:
            return self._run(experiments)
        finally:
            for base in self._bases.values():
                base.release_blocks()

    def _run(self, experiments: list[Experiment]) -> tuple[list[dict], list[dict]]:
        profile = self.dataset.profile
        context = self.spark.sparkContext
        results: dict[int, list[dict]] = {}
        failures: dict[int, tuple[str, str, str]] = {}
        linear: dict[int, tuple[Dataset, list]] = {}
        others: list[tuple[Experiment, Prefix]] = []
        by_id = {experiment.experiment_id: experiment for experiment in experiments}

        def fail(experiment: Experiment, exc: Exception) -> None:
            reason = (str(exc) or type(exc).__name__).splitlines()[0]
            failures[experiment.experiment_id] = ("failed", ModelExecutionError.error_type, reason)

        for experiment in experiments:
            context.setJobDescription(experiment.label(len(experiments)))
            skip = experiment.skip_reason(profile.any_negative)
            if skip:
                failures[experiment.experiment_id] = ("skipped", "incompatible_combo", skip)
                continue
            try:
                if profile.any_missing:
                    raise ModelExecutionError("Input contains NaN or null")
                prefix = self.prefix(experiment)
                fitted = self._linear(prefix, experiment.model)
            except MODEL_ERRORS as exc:
                fail(experiment, exc)
                continue
            if fitted is None:
                others.append((experiment, prefix))
            elif prefix.bases is None:
                maps = [
                    c.then(Affine(beta[:, None], np.array([intercept])))
                    for c, (beta, intercept) in zip(prefix.chain, fitted)
                ]
                _, models = linear.setdefault(id(prefix.base), (prefix.base, []))
                models.append((experiment.experiment_id, maps))
            else:
                try:
                    params = [
                        (c, h, b, i) for c, h, (b, i) in zip(prefix.chain, prefix.bases, fitted)
                    ]
                    scored = out_of_fold(prefix.base.design, linear_of_codes, params)
                    predictions = scored.select(
                        F.lit(experiment.experiment_id).alias("experiment_id"),
                        "fold", "y", F.get("z", F.lit(0)).alias("p"),
                    )
                    results.update(self._score(predictions))
                except MODEL_ERRORS as exc:
                    fail(experiment, exc)
        context.setJobDescription("score linear models")
        for base, models in linear.values():
            try:
                results.update(self._score_linear(base, models))
            except MODEL_ERRORS:  # one by one, to know whose fault it is
                for experiment_id, maps in models:
                    try:
                        results.update(self._score_linear(base, [(experiment_id, maps)]))
                    except MODEL_ERRORS as exc:
                        fail(by_id[experiment_id], exc)

        cached = [e.model for e, prefix in others if e.model.key not in TREE_COUNTS or not self._on_cells(prefix, e.model)]
        with ThreadPoolExecutor(self._fits_at_once(cached)) as pool:
            started = [
                (e, *self._start(pool, e, prefix, e.label(len(experiments)))) for e, prefix in others
            ]
            for experiment, futures, held in started:
                context.setJobDescription(experiment.label(len(experiments)))
                try:
                    results[experiment.experiment_id] = self._finish(experiment, futures, held)
                except MODEL_ERRORS as exc:
                    fail(experiment, exc)
        context.setJobDescription(None)

        detailed, failed = [], []
        for experiment in experiments:
            combo = experiment.row()
            scored = len(results.get(experiment.experiment_id, []))
            if experiment.experiment_id in results and scored < self.dataset.k:
                fail(experiment, ModelExecutionError(f"{scored} of {self.dataset.k} folds have rows to score"))
                del results[experiment.experiment_id]
            for row in results.get(experiment.experiment_id, []):
                detailed.append((*combo, row["fold"], *[row[x] for x in self.metrics]))
            if experiment.experiment_id in failures:
                failed.append((*combo, *failures[experiment.experiment_id]))
        return detailed, failed


def predict_on_codes(x: np.ndarray, param) -> np.ndarray:
    chain, basis, fitted, predict = param
    return predict(codes_of(x, (chain, basis)), fitted)


def fourier_vectors(table: DataFrame, mapping: tuple) -> DataFrame:
    design = table.select("fold", "y", vector_to_array("z").alias("x"))
    moved = apply_rows(design, it.fourier_features, mapping)
    return moved.select("fold", "y", array_to_vector("x").alias("z"))
