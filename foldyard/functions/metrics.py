"""Scores as aggregates over a predictions relation.

Predictions carry ``experiment_id``, ``fold``, ``y``, ``p`` and, for classification,
``score`` (higher means the positive class), ``p_true`` (probability given to the true
class) and ``probs`` (those of all classes, by class number), null when the model has
none. The result has one row per
(experiment_id, fold) and one double per metric; larger is always better.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigDataError
from ..operators.order_stats import rank_thresholds

KEYS = ["experiment_id", "fold"]
#: Score ranges of a ranking: one for so many rows, within these limits.
RANGE_ROWS = 200_000
SCORE_RANGES = (16, 1024)
#: Classes that a hit of ``top_k_accuracy`` may stand among.
TOP_K = 2
EPSILON = 2.220446049250313e-16

# Names accepted in [evaluation].metrics, per task.
REGRESSION_METRICS = (
    "neg_root_mean_squared_error",
    "neg_mean_squared_error",
    "r2",
    "neg_mean_absolute_error",
    "neg_median_absolute_error",
    "explained_variance",
    "max_error",
    "neg_max_error",
    "neg_mean_absolute_percentage_error",
    "neg_mean_squared_log_error",
    "neg_root_mean_squared_log_error",
)
COUNT_BASES = ("precision", "recall", "f1", "jaccard")
COUNT_AVERAGES = ("macro", "micro", "weighted")
CLASSIFICATION_METRICS = (
    "accuracy",
    "balanced_accuracy",
    "matthews_corrcoef",
    "roc_auc",
    "average_precision",
    "neg_log_loss",
    "neg_brier_score",
    "top_k_accuracy",
    "roc_auc_ovr",
    "roc_auc_ovr_weighted",
    "roc_auc_ovo",
    "roc_auc_ovo_weighted",
    *COUNT_BASES,
    *(f"{base}_{average}" for base in COUNT_BASES for average in COUNT_AVERAGES),
)
BINARY_ONLY = (*COUNT_BASES, "roc_auc", "average_precision")
RANK_METRICS = ("roc_auc", "average_precision")
LOSS_METRICS = ("neg_log_loss", "neg_brier_score", "top_k_accuracy")
PAIR_METRICS = ("roc_auc_ovr", "roc_auc_ovr_weighted", "roc_auc_ovo", "roc_auc_ovo_weighted")
#: Metrics that need the probabilities of all classes.
PROBABILITY_METRICS = ("neg_brier_score", "top_k_accuracy", *PAIR_METRICS)


def check_metrics(task: str, metrics: list[str]) -> None:
    known = REGRESSION_METRICS if task == "regression" else CLASSIFICATION_METRICS
    unknown = [m for m in metrics if m not in known]
    if unknown:
        raise ConfigDataError(f"Unknown {task} metrics: {unknown}")


def passes(task: str, metrics: list[str]) -> int:
    """How often the predictions are read to compute these metrics."""
    if task == "regression":
        return 4 if "neg_median_absolute_error" in metrics else 1
    ranked = any(m in RANK_METRICS for m in metrics)
    against = {m.removesuffix("_weighted") for m in metrics if m in PAIR_METRICS}
    losses = any(m in LOSS_METRICS for m in metrics)
    counted = any(m not in (*RANK_METRICS, *LOSS_METRICS, *PAIR_METRICS) for m in metrics)
    return 3 * ranked + 3 * len(against) + losses + counted


# -- regression ----------------------------------------------------------------------


def _explained(error: Column) -> Column:
    """1 - error / variance; a constant target scores 1 only when fitted exactly."""
    total = F.var_pop("y")
    return (
        F.when(F.count("*") < 2, F.lit(None))
        .when(total != 0, 1 - error / total)
        .when(error == 0, 1.0)
        .otherwise(0.0)
    )


def _regression_aggregate(name: str) -> Column:
    y, p = F.col("y"), F.col("p")
    r = y - p
    gap = F.log1p(F.greatest(y, F.lit(-1.0))) - F.log1p(F.greatest(p, F.lit(-1.0)))
    in_domain = ~F.bool_or((y <= -1) | (p <= -1))
    return {
        "neg_root_mean_squared_error": lambda: -F.sqrt(F.avg(r * r)),
        "neg_mean_squared_error": lambda: -F.avg(r * r),
        "r2": lambda: _explained(F.avg(r * r)),
        "neg_mean_absolute_error": lambda: -F.avg(F.abs(r)),
        "explained_variance": lambda: _explained(F.var_pop(r)),
        "max_error": lambda: -F.max(F.abs(r)),
        "neg_max_error": lambda: -F.max(F.abs(r)),
        "neg_mean_absolute_percentage_error": lambda: -F.avg(
            F.abs(r) / F.greatest(F.abs(y), F.lit(EPSILON))
        ),
        "neg_mean_squared_log_error": lambda: F.when(in_domain, -F.avg(gap * gap)),
        "neg_root_mean_squared_log_error": lambda: F.when(
            in_domain, -F.sqrt(F.avg(gap * gap))
        ),
    }[name]()


def _median_absolute_errors(predictions: DataFrame) -> DataFrame:
    """Exact medians by rank, without collecting or sorting a fold's errors."""
    errors = predictions.select(*KEYS, F.abs(F.col("y") - F.col("p")).alias("e"))
    sizes = {(r[0], r[1]): r[2] for r in errors.groupBy(*KEYS).count().collect()}
    ranks = {s: sorted({(n - 1) // 2, n // 2}) for s, n in sizes.items()}
    found = rank_thresholds(errors, ["e"], ranks, strata=KEYS)
    rows = []
    for stratum, at in found.items():
        middle = [value[0] for value in at.values()]
        rows.append((*stratum, -sum(middle) / len(middle)))
    types = dict(predictions.dtypes)
    return predictions.sparkSession.createDataFrame(
        rows,
        f"experiment_id {types['experiment_id']}, fold {types['fold']}, "
        "neg_median_absolute_error double",
    )


def regression_scores(predictions: DataFrame, metrics: list[str]) -> DataFrame:
    plain = [m for m in metrics if m != "neg_median_absolute_error"]
    aggregates = [_regression_aggregate(m).alias(m) for m in plain]
    scores = predictions.groupBy(*KEYS).agg(*(aggregates or [F.count("*").alias("_n")]))
    if len(plain) < len(metrics):
        scores = scores.join(_median_absolute_errors(predictions), KEYS)
    return scores.select(*KEYS, *metrics)


# -- classification ------------------------------------------------------------------


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts per experiment, fold, true and predicted class."""
    return predictions.groupBy(*KEYS, "y", "p").agg(F.count("*").alias("n"))


def label_counts(predictions: DataFrame) -> DataFrame:
    """tp, true count ``s`` and predicted count ``q`` of every label seen in y or p."""
    n, hit = F.col("n"), F.col("y") == F.col("p")
    as_true = F.struct(
        F.col("y").alias("label"),
        F.when(hit, n).otherwise(0).alias("tp"), n.alias("s"), F.lit(0).cast("long").alias("q"),
    )
    as_predicted = F.struct(
        F.col("p").alias("label"),
        F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("s"), n.alias("q"),
    )
    return (
        confusion(predictions)
        .select(*KEYS, F.inline(F.array(as_true, as_predicted)))
        .groupBy(*KEYS, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    )


def _ratio(base: str, tp: Column, s: Column, q: Column) -> Column:
    """A per-label score from its counts; 0 where it is undefined."""
    top, bottom = {
        "precision": (tp, q),
        "recall": (tp, s),
        "f1": (2 * tp, s + q),
        "jaccard": (tp, s + q - tp),
    }[base]
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def _count_aggregate(name: str, positive: float) -> Column:
    tp, s, q = F.col("tp"), F.col("s"), F.col("q")
    if name == "accuracy":
        return F.sum(tp) / F.sum(s)
    if name == "balanced_accuracy":
        return F.avg(F.when(s > 0, tp / s))
    if name == "matthews_corrcoef":
        total = F.sum(s).cast("double")
        cover = F.sum(tp) * total - F.sum(s.cast("double") * q)
        spread = (total * total - F.sum(q.cast("double") * q)) * (
            total * total - F.sum(s.cast("double") * s)
        )
        return F.when(spread == 0, 0.0).otherwise(cover / F.sqrt(spread))
    base, _, average = name.partition("_")
    if not average:
        return F.max(F.when(F.col("label") == positive, _ratio(base, tp, s, q)).otherwise(0.0))
    if average == "macro":
        return F.avg(_ratio(base, tp, s, q))
    if average == "weighted":
        return F.sum(_ratio(base, tp, s, q) * s) / F.sum(s)
    return _ratio(base, F.sum(tp), F.sum(s), F.sum(q))


def _ranked_scores(predictions: DataFrame, metrics: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Area under the ROC curve and average precision per ``keys``, and the rows ``n``,
    from running class counts.

    Equal scores are combined in the map tasks, so a score shared by many rows is one
    row. Running counts are taken inside score ranges of similar size and shifted by
    the totals of the higher ranges; no window spans a whole fold.
    """
    positive, negative = F.count_if(F.col("y") == 1), F.count_if(F.col("y") != 1)
    low, high = SCORE_RANGES
    shares = [i / high for i in range(1, high)]
    rows, edges = predictions.agg(F.count("*"), F.percentile_approx("score", shares)).first()
    ranges = min(max(rows // RANGE_ROWS, low), high)
    edges = (edges or [])[:: high // ranges]
    inf = float("inf")
    scored = Bucketizer(
        splits=[-inf, *(sorted(set(edges)) or [0.0]), inf], inputCol="score", outputCol="part"
    ).transform(predictions.select(*keys, "y", "score"))
    points = scored.groupBy(*keys, "part", "score").agg(
        positive.alias("pos"), negative.alias("neg")
    )
    totals = scored.groupBy(*keys, "part").agg(
        positive.alias("part_pos"), negative.alias("part_neg")
    )
    ranges = Window.partitionBy(*keys).orderBy(F.desc("part"))  # a row a range
    above = ranges.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = totals.select(
        *keys,
        "part",
        F.coalesce(F.sum("part_pos").over(above), F.lit(0)).alias("above_pos"),
        F.coalesce(F.sum("part_neg").over(above), F.lit(0)).alias("above_neg"),
        F.sum("part_pos").over(whole).alias("all_pos"),
        F.sum("part_neg").over(whole).alias("all_neg"),
    )
    inside = (
        Window.partitionBy(*keys, "part")
        .orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    points = (
        points.withColumn("run_pos", F.sum("pos").over(inside))
        .withColumn("run_neg", F.sum("neg").over(inside))
        .join(totals, [*keys, "part"])
    )
    reached_pos = F.col("above_pos") + F.col("run_pos")  # positives at this score or higher
    reached_neg = F.col("above_neg") + F.col("run_neg")
    lower_neg = F.col("all_neg") - reached_neg
    pairs = F.col("pos").cast("double") * (lower_neg + F.col("neg") / 2)
    precision = reached_pos / (reached_pos + reached_neg)
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    columns = {
        "roc_auc": F.when(
            both,
            F.sum(pairs) / (F.max("all_pos").cast("double") * F.max("all_neg")),
        ),
        "average_precision": F.when(
            F.max("all_pos") > 0, F.sum(F.col("pos") * precision) / F.max("all_pos")
        ).otherwise(0.0),
    }
    n = (F.max("all_pos") + F.max("all_neg")).alias("n")
    return points.groupBy(*keys).agg(*[columns[m].alias(m) for m in metrics], n)


def _class_against_rest(predictions: DataFrame, wanted: list[str]) -> DataFrame:
    """Area under the curve of each class's probability against all others, averaged over
    the classes, evenly or by their rows. Null where a class has no row in the fold."""
    rows = predictions.select(*KEYS, "y", F.posexplode("probs").alias("c", "score"))
    hits = rows.withColumn("y", (F.col("y") == F.col("c")).cast("int"))
    areas = _ranked_scores(hits, ["roc_auc"], [*KEYS, "c"])
    sizes = hits.groupBy(*KEYS, "c").agg(F.sum("y").alias("own"))
    return _mean_area(areas.join(sizes, [*KEYS, "c"]), wanted, "roc_auc_ovr", F.col("own"))


def _class_against_class(predictions: DataFrame, wanted: list[str]) -> DataFrame:
    """For each pair of classes the mean of both areas under the curve, each class's
    probability ranking the rows of the two; averaged over pairs, evenly or by rows. Null
    where a class has no row in the fold.

    A row takes part once for its own class's probability against each other class, and
    once for each other class's probability against its own.
    """
    own = F.col("y").cast("int")
    rows = predictions.select(*KEYS, own.alias("own"), "probs", F.posexplode("probs").alias("other", "p"))
    rows = rows.where(F.col("own") != F.col("other"))
    first, second = F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second")
    sides = F.array(
        F.struct(F.col("own").alias("by"), F.get("probs", F.col("own")).alias("score"), F.lit(1).alias("y")),
        F.struct(F.col("other").alias("by"), F.col("p").alias("score"), F.lit(0).alias("y")),
    )
    exploded = rows.select(*KEYS, first, second, F.inline(sides))
    areas = _ranked_scores(exploded, ["roc_auc"], [*KEYS, "first", "second", "by"])
    full = F.when(F.count("roc_auc") == 2, F.avg("roc_auc")).alias("roc_auc")
    pairs = areas.groupBy(*KEYS, "first", "second").agg(full, F.max("n").alias("n"))
    classes = predictions.groupBy(*KEYS).agg(F.max(F.size("probs")).alias("classes"))
    # A pair none of whose rows stand in the fold is missing: the number of pairs tells.
    return _mean_area(pairs.join(classes, KEYS), wanted, "roc_auc_ovo", F.col("n"), F.max("classes") * (F.max("classes") - 1) / 2)


def _mean_area(areas: DataFrame, wanted: list[str], name: str, weight: Column, expected: Column | None = None) -> DataFrame:
    complete = F.count("roc_auc") == (F.count("*") if expected is None else expected)
    columns = {
        name: F.when(complete, F.avg("roc_auc")),
        f"{name}_weighted": F.when(complete, F.sum(F.col("roc_auc") * weight) / F.sum(weight)),
    }
    return areas.groupBy(*KEYS).agg(*[columns[m].alias(m) for m in wanted])


def _loss_aggregate(name: str) -> Column:
    if name == "neg_log_loss":
        p = F.least(F.greatest(F.col("p_true"), F.lit(EPSILON)), F.lit(1 - EPSILON))
        return F.avg(F.log(p))
    probs, own = F.col("probs"), F.col("y").cast("int")
    if name == "neg_brier_score":
        gaps = F.transform(probs, lambda p, c: F.pow(p - (c == own).cast("int"), F.lit(2)))
        total = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x)
        return -F.avg(F.when(F.size(probs) == 2, total / 2).otherwise(total))
    mine = F.get(probs, own)
    above = F.size(F.filter(probs, lambda p, c: (p > mine) | ((p == mine) & (c > own))))
    return F.avg((above < TOP_K).cast("int"))


def classification_scores(
    predictions: DataFrame, metrics: list[str], positive: float = 1
) -> DataFrame:
    """Scores per experiment and fold; ``positive`` is the label that counts as hit."""
    ranked = [m for m in metrics if m in RANK_METRICS]
    losses = [m for m in metrics if m in LOSS_METRICS]
    counted = [m for m in metrics if m not in (*RANK_METRICS, *LOSS_METRICS, *PAIR_METRICS)]
    parts = []
    if counted:
        aggregates = [_count_aggregate(m, positive).alias(m) for m in counted]
        parts.append(label_counts(predictions).groupBy(*KEYS).agg(*aggregates))
    if losses:
        parts.append(predictions.groupBy(*KEYS).agg(*[_loss_aggregate(m).alias(m) for m in losses]))
    if ranked:
        parts.append(_ranked_scores(predictions, ranked))
    for prefix, scorer in (("roc_auc_ovr", _class_against_rest), ("roc_auc_ovo", _class_against_class)):
        wanted = [m for m in metrics if m.startswith(prefix)]
        if wanted:
            parts.append(scorer(predictions, wanted))
    scores = reduce(lambda a, b: a.join(b, KEYS), parts)
    return scores.select(*KEYS, *metrics)


def scores(task: str, predictions: DataFrame, metrics: list[str]) -> DataFrame:
    score = regression_scores if task == "regression" else classification_scores
    return score(predictions, metrics)
