"""Registered queries over iterative models and reductions, with their iterations in SQL.

Each SQL text repeats the estimator's steps from its definition: one table of parameters
a step, one aggregate over the training rows of every fold model. Two-class problems,
two or three parameters and small networks keep the algebra readable; the library code
that they check is the general one.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from .operators import iterative as it
from .operators.features import Affine
from .operators.folds import FOLD_ID, PartitionSpec, random_folds
from .operators.sums import fold_sums
from .plans.api import run_experiments
from .plans.dataset import Dataset
from .plans.experiments import expand
from .plans.progress import Progress
from .plans.registry import register
from .queries import (
    K,
    LINE_KEY,
    METRICS,
    PLS_COMBOS,
    PLS_SEARCH,
    _search,
    keyed_fold_sql,
    lineitem_dataset,
    models_sql,
    pls1_sql,
    query,
    table,
)
from .session import scratch_path


def _base_sql(y: str, **features: str) -> str:
    columns = ", ".join(f"CAST({text} AS DOUBLE) AS {name}" for name, text in features.items())
    fold = keyed_fold_sql(LINE_KEY, K)
    return f"base AS MATERIALIZED (SELECT {fold} AS fold, {y} AS y, {columns} FROM lineitem), {models_sql()}"


def _data(spark, sf_dir, task: str, y: str, **features: str) -> Dataset:
    rows = random_folds(table(spark, sf_dir, "lineitem"), PartitionSpec(n_splits=K), LINE_KEY)
    columns = {name: F.expr(text).cast("double") for name, text in features.items()}
    return Dataset.build(rows.withColumns({"y": F.expr(y), **columns}), list(features), "y", task, FOLD_ID)


def _chain(steps: int, start: str, sums: str, update) -> str:
    """s0 .. s<steps>: parameters of each fold model m; g<i>: sums over its training rows.
    ``update(i)`` names the columns of the next parameters."""
    parts = [f"s0 AS MATERIALIZED ({start})"]
    for i in range(steps):
        parts.append(f"g{i} AS MATERIALIZED (SELECT m, {sums} FROM s{i} JOIN base ON fold <> m GROUP BY m)")
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT m, {update(i)} FROM s{i} JOIN g{i} USING (m))")
    return ",\n".join(parts)


def _detailed(spark, data: Dataset, task: str, search: dict, metrics: list[str], digits: dict[str, int]):
    results = run_experiments(spark, data, task, expand(task, {"search": search}), metrics, metrics[0])
    return results.detailed.select("fold", *(F.round(m, digits.get(m, 6)).alias(m) for m in metrics))


REGRESSION_SQL = """SELECT m AS fold, round(-sqrt(avg((y - p) ** 2)), 4) AS neg_root_mean_squared_error,
      round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS r2 FROM scored GROUP BY m"""
RMSE_DIGITS = {METRICS[0]: 4}

# -- logistic regression ---------------------------------------------------------------

LOUD = "CASE WHEN l_extendedprice > 1000 * l_quantity + 20000 * l_discount THEN 1 ELSE 0 END"
#: Centred and scaled by hand, so that the penalty weighs both alike.
QUANTITY, PRICE = "(l_quantity - 25) / 15", "(l_extendedprice - 35000) / 20000"
CLASS_METRICS = ["neg_log_loss", "accuracy", "f1_macro"]


def _newton_sql(class_weight: str = "1") -> str:
    """Newton steps of |w|^2/2 + log loss with two features and an intercept, solved by
    Cramer's rule; twenty steps from zero are past any rounding."""
    z = "(w0 * x0 + w1 * x1 + b)"
    p = f"(1 / (1 + exp(-{z})))"
    h, r = f"{class_weight} * {p} * (1 - {p})", f"{class_weight} * ({p} - y)"
    sums = f"""1 + sum({h} * x0 * x0) AS a, sum({h} * x0 * x1) AS d, sum({h} * x0) AS e,
        1 + sum({h} * x1 * x1) AS f, sum({h} * x1) AS g, sum({h}) AS i,
        any_value(w0) + sum({r} * x0) AS u, any_value(w1) + sum({r} * x1) AS v, sum({r}) AS w"""
    det = "(a * (f * i - g * g) - d * (d * i - g * e) + e * (d * g - f * e))"

    def update(_: int) -> str:
        return f"""w0 - (u * (f * i - g * g) - d * (v * i - g * w) + e * (v * g - f * w)) / {det} AS w0,
        w1 - (a * (v * i - g * w) - u * (d * i - g * e) + e * (d * w - v * e)) / {det} AS w1,
        b - (a * (f * w - v * g) - d * (d * w - v * e) + u * (d * g - f * e)) / {det} AS b"""

    return _chain(20, "SELECT m, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS b FROM models", sums, update)


CLASS_SCORES_SQL = """marks AS (SELECT m, y, (z > 0)::INT AS p, z FROM scored),
    labels AS (SELECT m, c, sum((y = c AND p = c)::INT) AS tp, sum((y = c)::INT) AS s, sum((p = c)::INT) AS q
      FROM marks, (VALUES (0), (1)) v(c) GROUP BY m, c),
    f1 AS (SELECT m, avg(CASE WHEN s + q = 0 THEN 0 ELSE 2 * tp / (s + q) END) AS f1 FROM labels GROUP BY m)"""


@query(
    f"""WITH {_base_sql(LOUD, x0=QUANTITY, x1=PRICE)}, {_newton_sql()},
    scored AS (SELECT m, y, w0 * x0 + w1 * x1 + b AS z FROM base JOIN s20 ON fold = m), {CLASS_SCORES_SQL}
    SELECT m AS fold, round(avg(-ln(1 + exp(CASE WHEN y = 1 THEN -z ELSE z END))), 6) AS neg_log_loss,
      round(avg((y = p)::INT), 6) AS accuracy, round(any_value(f1), 6) AS f1_macro
    FROM marks JOIN f1 USING (m) GROUP BY m"""
)
def logistic_cv_scores(spark, sf_dir):
    """Logistic regression with library defaults, two features."""
    data = _data(spark, sf_dir, "classification", LOUD, x0=QUANTITY, x1=PRICE)
    return _detailed(spark, data, "classification", _search(model=("logreg",)), CLASS_METRICS, {})


BALANCED = "(CASE WHEN y = 1 THEN heavy ELSE light END)"


@query(
    f"""WITH {_base_sql(LOUD, x0=QUANTITY, x1=PRICE)},
    weighed AS (SELECT m, count(*) / (2.0 * sum(y)) AS heavy, count(*) / (2.0 * sum(1 - y)) AS light
      FROM models JOIN base ON fold <> m GROUP BY m),
    {_newton_sql(BALANCED).replace(" JOIN base ON fold <> m", " JOIN weighed USING (m) JOIN base ON fold <> m")},
    scored AS (SELECT m, y, w0 * x0 + w1 * x1 + b AS z FROM base JOIN s20 ON fold = m), {CLASS_SCORES_SQL}
    SELECT m AS fold, round(avg(-ln(1 + exp(CASE WHEN y = 1 THEN -z ELSE z END))), 6) AS neg_log_loss,
      round(avg((y = p)::INT), 6) AS accuracy, round(any_value(f1), 6) AS f1_macro
    FROM marks JOIN f1 USING (m) GROUP BY m"""
)
def logistic_balanced_cv_scores(spark, sf_dir):
    """The same with classes weighed by their rows."""
    data = _data(spark, sf_dir, "classification", LOUD, x0=QUANTITY, x1=PRICE)
    search = _search(model=("logreg",), logreg={"class_weight": "balanced"})
    return _detailed(spark, data, "classification", search, CLASS_METRICS, {})


# -- support vectors -------------------------------------------------------------------


def _reweighted_sql(start: str, weight: str, goal: str, loss: str, spread: str, c: float, steps: int, tol: float) -> str:
    """Reweighted normal equations of one slope and an intercept, the best kept."""
    sums = f"""sum({weight} * x * x) AS xx, sum({weight} * x) AS sx, sum({weight}) AS s1,
        sum({weight} * x * {goal}) AS xg, sum({weight} * {goal}) AS sg, sum({loss}) AS loss"""

    def update(i: int) -> str:
        value = f"(w * w / 2 + {c} * loss)"
        a, d, e = f"({c} * xx + 1)", f"({c} * sx)", f"({c} * s1 + 1e-9)"
        det = f"({a} * {e} - {d} * {d})"
        rest = "settled" if i < it.FLOOR_STEPS else f"(settled OR abs(last - {value}) <= {tol} * abs(last))"
        floor = f"{spread} * pow(10, -least({2 + (i + 1) / 4}, 6))"
        return f"""CASE WHEN settled THEN w ELSE ({e} * {c} * xg - {d} * {c} * sg) / {det} END AS w,
        CASE WHEN settled THEN b ELSE ({a} * {c} * sg - {d} * {c} * xg) / {det} END AS b,
        CASE WHEN NOT settled AND {value} < best THEN {value} ELSE best END AS best,
        CASE WHEN NOT settled AND {value} < best THEN w ELSE best_w END AS best_w,
        CASE WHEN NOT settled AND {value} < best THEN b ELSE best_b END AS best_b,
        CASE WHEN settled THEN last ELSE {value} END AS last, {rest} AS settled,
        spread, {floor.replace(spread, "spread")} AS floor"""

    first = f"""SELECT m, 0.0::DOUBLE AS w, {start} AS b, 'inf'::DOUBLE AS best, 0.0::DOUBLE AS best_w,
      0.0::DOUBLE AS best_b, 'inf'::DOUBLE AS last, false AS settled, {spread} AS spread, {spread} * 0.01 AS floor
      FROM models JOIN base ON fold <> m GROUP BY m"""
    return _chain(steps, first, sums, update)


STEPS = 40
RESIDUAL = "(y - w * x - b)"


@query(
    f"""WITH {_base_sql("l_extendedprice", x="l_quantity")},
    {_reweighted_sql(
        "avg(y)", f"(CASE WHEN abs({RESIDUAL}) <= 0.1 THEN 0 ELSE 1 / greatest(abs({RESIDUAL}) - 0.1, floor) END)",
        f"(y - sign({RESIDUAL}) * 0.1)", f"greatest(abs({RESIDUAL}) - 0.1, 0)", "stddev_pop(y)", 1.0, STEPS, 1e-3)},
    scored AS (SELECT m, y, best_w * x + best_b AS p FROM base JOIN s{STEPS} ON fold = m)
    {REGRESSION_SQL}"""
)
def svm_linear_cv_scores(spark, sf_dir):
    """Support vector regression, linear kernel, library defaults."""
    data = _data(spark, sf_dir, "regression", "l_extendedprice", x="l_quantity")
    search = _search(model=("svm",), svm={"kernel": "linear"})
    return _detailed(spark, data, "regression", search, METRICS, RMSE_DIGITS)


SIDE = "(2 * y - 1)"
MARGIN_GAP = f"(1 - {SIDE} * (w * x + b))"
MANY = "CASE WHEN l_quantity > 15 + 3 * l_linenumber THEN 1 ELSE 0 END"


@query(
    f"""WITH {_base_sql(MANY, x=QUANTITY)},
    {_reweighted_sql(
        "0.0::DOUBLE", f"(1 / (2 * greatest(abs({MARGIN_GAP}), floor)))",
        f"({SIDE} * (1 + greatest(abs({MARGIN_GAP}), floor)))", f"greatest({MARGIN_GAP}, 0)",
        "1.0::DOUBLE", 1.0, STEPS, 1e-3)},
    drawn AS (SELECT m, (sum(y) + 1) / (sum(y) + 2) AS high, 1 / (count(*) - sum(y) + 2) AS low
      FROM models JOIN base ON fold <> m GROUP BY m),
    margins AS MATERIALIZED (SELECT m, fold, y, best_w * x + best_b AS z, CASE WHEN y = 1 THEN high ELSE low END AS t
      FROM base, s{STEPS} JOIN drawn USING (m)),
    p0 AS (SELECT m, 0.0::DOUBLE AS a, 0.0::DOUBLE AS c FROM models),
    {",".join(f'''
    q{i} AS MATERIALIZED (SELECT m, 1e-6 * a + sum(r * z) AS u, sum(r) AS v, 1e-6 + sum(h * z * z) AS zz, sum(h * z) AS sz,
        sum(h) AS s1, any_value(a) AS a, any_value(c) AS c FROM (
          SELECT m, z, a, c, 1 / (1 + exp(-a * z - c)) - t AS r,
            1 / (1 + exp(-a * z - c)) * (1 - 1 / (1 + exp(-a * z - c))) AS h
          FROM margins JOIN p{i} USING (m) WHERE fold <> m) GROUP BY m, a, c),
    p{i + 1} AS (SELECT m, a - (u * s1 - sz * v) / (zz * s1 - sz * sz) AS a,
        c - (zz * v - sz * u) / (zz * s1 - sz * sz) AS c FROM q{i})''' for i in range(12))},
    scored AS (SELECT m, y, z, a * z + c AS l FROM margins JOIN p12 USING (m) WHERE fold = m)
    SELECT m AS fold, round(avg(-ln(1 + exp(CASE WHEN y = 1 THEN -l ELSE l END))), 5) AS neg_log_loss,
      round(avg((y = (z > 0)::INT)::INT), 6) AS accuracy FROM scored GROUP BY m"""
)
def svc_linear_cv_scores(spark, sf_dir):
    """Hinge loss, linear kernel, and probabilities from a sigmoid of the margins."""
    data = _data(spark, sf_dir, "classification", MANY, x=QUANTITY)
    search = _search(model=("svc",), svc={"kernel": "linear"})
    return _detailed(spark, data, "classification", search, ["neg_log_loss", "accuracy"], {"neg_log_loss": 5})


# -- a small network --------------------------------------------------------------------

MLP = {"hidden_layer_sizes": [[2]], "activation": "tanh", "max_iter": 40, "n_iter_no_change": 40}


def _network_sql(steps: int) -> str:
    """Adam on the full gradient of one input, two tanh units and one output."""
    rng = np.random.default_rng(it.DEFAULT_SEED)
    first, second = np.sqrt(6 / 3), np.sqrt(6 / 3)
    theta = [*rng.uniform(-first, first, 2), *rng.uniform(-first, first, 2)]
    theta += [*rng.uniform(-second, second, 2), *rng.uniform(-second, second, 1)]
    names = ["t0", "t1", "t2", "t3", "t4", "t5", "t6"]  # w, w, bias, bias, out, out, bias
    units = [f"tanh(t{j} * x + t{2 + j})" for j in range(2)]
    gap = f"({units[0]} * t4 + {units[1]} * t5 + t6 - (y - mean) / spread)"
    back = [f"{gap} * t{4 + j} * (1 - {units[j]} * {units[j]})" for j in range(2)]
    slopes = [f"{back[0]} * x", f"{back[1]} * x", back[0], back[1], f"{gap} * {units[0]}", f"{gap} * {units[1]}", gap]
    sums = f"count(*) AS n, sum({gap} * {gap}) / 2 AS loss, " + ", ".join(f"sum({s}) AS d{j}" for j, s in enumerate(slopes))
    square = " + ".join(f"{t} * {t}" for t in names)

    def update(i: int) -> str:
        value = f"((loss + 0.00005 * ({square})) / n)"
        parts = []
        for j, t in enumerate(names):
            grad = f"((d{j} + 0.0001 * {t}) / n)"
            one, two = f"(0.9 * a{j} + 0.1 * {grad})", f"(0.999 * b{j} + 0.001 * {grad} * {grad})"
            move = f"({one} / {1 - 0.9 ** (i + 1)!r}) / (sqrt({two} / {1 - 0.999 ** (i + 1)!r}) + 1e-8)"
            parts += [f"{t} - 0.04 * {move} AS {t}", f"{one} AS a{j}", f"{two} AS b{j}"]
            parts.append(f"CASE WHEN {value} < best THEN {t} ELSE k{j} END AS k{j}")
        return ", ".join([*parts, f"least(best, {value}) AS best", "mean", "spread"])

    start = ", ".join(f"{v!r}::DOUBLE AS t{j}, 0.0::DOUBLE AS a{j}, 0.0::DOUBLE AS b{j}, {v!r}::DOUBLE AS k{j}" for j, v in enumerate(map(float, theta)))
    first_sql = f"""SELECT m, {start}, 'inf'::DOUBLE AS best, avg(y) AS mean, stddev_pop(y) AS spread
      FROM models JOIN base ON fold <> m GROUP BY m"""
    return _chain(steps, first_sql, sums, update)


@query(
    f"""WITH {_base_sql("l_extendedprice", x=QUANTITY)}, {_network_sql(MLP["max_iter"])},
    scored AS (SELECT m, y, (tanh(k0 * x + k2) * k4 + tanh(k1 * x + k3) * k5 + k6) * spread + mean AS p
      FROM base JOIN s{MLP["max_iter"]} ON fold = m)
    {REGRESSION_SQL}"""
)
def mlp_cv_scores(spark, sf_dir):
    """A network of two hidden units, forty steps."""
    data = _data(spark, sf_dir, "regression", "l_extendedprice", x=QUANTITY)
    return _detailed(spark, data, "regression", _search(model=("mlp",), mlp=MLP), METRICS, RMSE_DIGITS)


# -- reductions --------------------------------------------------------------------------

MIX = {"x0": "l_quantity + 150 * l_discount", "x1": "l_quantity - 400 * l_discount"}


def _components_sql(steps: int) -> str:
    """Whitening by a Cholesky factor, then the symmetric fixed-point rotation from the
    identity; 2 x 2 roots in closed form."""
    sums = ", ".join(
        [f"avg(tanh(u{i}0 * z0 + u{i}1 * z1) * z{j}) AS c{i}{j}" for i in range(2) for j in range(2)]
        + [f"avg(1 - pow(tanh(u{i}0 * z0 + u{i}1 * z1), 2)) AS h{i}" for i in range(2)]
    )

    def update(_: int) -> str:
        n = [[f"(c{i}{j} - h{i} * u{i}{j})" for j in range(2)] for i in range(2)]
        a = f"({n[0][0]} * {n[0][0]} + {n[0][1]} * {n[0][1]})"
        d = f"({n[0][0]} * {n[1][0]} + {n[0][1]} * {n[1][1]})"
        f = f"({n[1][0]} * {n[1][0]} + {n[1][1]} * {n[1][1]})"
        root = f"sqrt({a} * {f} - {d} * {d})"  # of the determinant
        scale = f"({root} * sqrt({a} + {f} + 2 * {root}))"  # inverse root = adjugate of (A + root I) / scale
        rows = [
            [f"(({f} + {root}) * {n[0][j]} - {d} * {n[1][j]}) / {scale}" for j in range(2)],
            [f"(({a} + {root}) * {n[1][j]} - {d} * {n[0][j]}) / {scale}" for j in range(2)],
        ]
        return ", ".join(f"{rows[i][j]} AS u{i}{j}" for i in range(2) for j in range(2))

    start = "SELECT m, 1.0::DOUBLE AS u00, 0.0::DOUBLE AS u01, 0.0::DOUBLE AS u10, 1.0::DOUBLE AS u11 FROM models"
    parts = _chain(steps, start, sums, update)
    return parts.replace("JOIN base ON fold <> m", "JOIN white USING (m)")


@query(
    f"""WITH {_base_sql("l_extendedprice", **MIX)},
    st AS (SELECT m, avg(x0) AS m0, avg(x1) AS m1, var_pop(x0) AS a, covar_pop(x0, x1) AS b, var_pop(x1) AS c
      FROM models JOIN base ON fold <> m GROUP BY m),
    white AS MATERIALIZED (SELECT m, (x0 - m0) / sqrt(a) AS z0,
        (x1 - m1 - b / a * (x0 - m0)) / sqrt(c - b * b / a) AS z1 FROM st JOIN base ON fold <> m),
    {_components_sql(12)},
    found AS (SELECT m, [avg(pow(u00 * z0 + u01 * z1, 4)) - 3, avg(pow(u10 * z0 + u11 * z1, 4)) - 3] AS k
      FROM white JOIN s12 USING (m) GROUP BY m)
    SELECT m AS fold, i - 1 AS component, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS variance,
      round(list_sort(k)[i], 4) AS kurtosis FROM found, (VALUES (1), (2)) v(i)"""
)
def ica_components(spark, sf_dir):
    """Independent components of two mixed columns: moments of each over the training
    rows, flattest first."""
    data = _data(spark, sf_dir, "regression", "l_extendedprice", **MIX)
    before = [Affine.identity(2)] * data.k
    steps = it.fit_ica(data.blocks, data.train_moments, before, tol=1e-9)
    sums = fold_sums(data.blocks, _power_sums, steps, 7)
    data.release_blocks()
    rows = []
    for m, total in enumerate(sums):
        mean, square, fourth = (total[i : i + 2] / total[6] for i in (0, 2, 4))
        for c, i in enumerate(np.argsort(fourth / square**2)):
            kurtosis = fourth[i] / square[i] ** 2 - 3
            rows.append((m, c, abs(round(float(mean[i]), 6)), round(float(square[i]), 6), round(float(kurtosis), 4)))
    return spark.createDataFrame(rows, "fold int, component int, mean double, variance double, kurtosis double")


def _power_sums(x, y, step):
    z = step.apply(x)
    return np.concatenate([z.sum(0), (z**2).sum(0), (z**4).sum(0), [len(z)]])


@query(
    f"""WITH {_base_sql("l_extendedprice", x0="l_quantity", x1="l_linenumber")},
    st AS (SELECT m, sum(x0 * x0) AS a, sum(x0 * x1) AS b, sum(x1 * x1) AS c
      FROM models JOIN base ON fold <> m GROUP BY m),
    axis AS (SELECT m, b AS h0, (c - a) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS h1 FROM st),
    codes AS (SELECT m, fold, y, (x0 * h0 + x1 * h1) / (h0 * h0 + h1 * h1) AS w FROM base, axis),
    line AS (SELECT m, regr_slope(y, w) AS slope, regr_intercept(y, w) AS base FROM codes WHERE fold <> m GROUP BY m),
    scored AS (SELECT m, y, line.base + slope * w AS p FROM codes JOIN line USING (m) WHERE fold = m)
    {REGRESSION_SQL}"""
)
def nmf_rank1_cv_scores(spark, sf_dir):
    """One non-negative factor is the leading axis of the raw second moments."""
    data = _data(spark, sf_dir, "regression", "l_extendedprice", x0="l_quantity", x1="l_linenumber")
    search = _search(
        reduction=("nmf",), nmf={"n_components": 1, "tol": 1e-13}, pls={"n_components": 1},
    )
    return _detailed(spark, data, "regression", search, METRICS, RMSE_DIGITS)


# -- techniques of the user, runs that continue ------------------------------------------


def _centred(moments, shrink=1.0):
    return Affine.centred(moments.x_mean, shrink * np.eye(len(moments.x_mean)))


def _ordinary(regParam=0.0):
    return LinearRegression(featuresCol="z", labelCol="y", solver="normal", regParam=regParam, standardization=False)


@query(
    f"""WITH {_base_sql("l_extendedprice", x="l_quantity")},
    st AS (SELECT m, avg(x) AS mx, avg(y) AS my, var_pop(x) AS v, covar_pop(x, y) AS c,
        stddev_samp(y) AS s FROM models JOIN base ON fold <> m GROUP BY m),
    ridge(experiment_id, r) AS (VALUES (1, 0.0), (2, 4.0)),
    scored AS (SELECT experiment_id, m, y, my + 0.5 * (x - mx) * (0.5 * c) / (0.25 * v + r / s) AS p
      FROM base JOIN st ON fold = m, ridge)
    SELECT experiment_id, m AS fold, round(-sqrt(avg((y - p) ** 2)), 4) AS neg_root_mean_squared_error,
      round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS r2 FROM scored GROUP BY experiment_id, m"""
)
def custom_techniques(spark, sf_dir):
    """A scaling step and a Spark ML estimator that the user registers (the estimator
    divides its penalty by the deviation of the target)."""
    register("regression", "scale", "half_centred", _centred, ["shrink"], cost=1.01)
    register("regression", "model", "ordinary", _ordinary, ["regParam"], cost=1.1)
    data = _data(spark, sf_dir, "regression", "l_extendedprice", x="l_quantity")
    search = _search(
        scale=("half_centred",), model=("ordinary",), half_centred={"shrink": 0.5}, ordinary={"regParam": [0.0, 4.0]}
    )
    results = run_experiments(spark, data, "regression", expand("regression", {"search": search}), METRICS, METRICS[0])
    return results.detailed.select("experiment_id", "fold", *(F.round(m, RMSE_DIGITS.get(m, 6)).alias(m) for m in METRICS))


@query(
    f"""WITH {pls1_sql()}, {PLS_COMBOS}
    SELECT experiment_id, m AS fold, round(r2, 6) AS r2 FROM combos JOIN scores USING (variant)"""
)
def resumed_run(spark, sf_dir):
    """A run whose first two experiments had ended before it was stopped."""
    experiments = expand("regression", {"search": PLS_SEARCH})
    progress = Progress(spark, f"{scratch_path(spark)}/progress", sf_dir)
    for part in (experiments[:2], experiments):
        data = lineitem_dataset(spark, sf_dir)
        results = run_experiments(spark, data, "regression", part, METRICS, METRICS[0], progress=progress)
        data.release()
    return results.detailed.select("experiment_id", "fold", F.round("r2", 6).alias("r2"))
