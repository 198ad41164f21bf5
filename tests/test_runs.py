"""Whole runs: prepare, plan, benchmark, statuses, sinks."""

import copy

import pytest
from pyspark.sql import functions as F

import foldyard as fy
from foldyard.errors import ConfigDataError, ModelExecutionError
from foldyard.plans import report
from foldyard.plans.engine import Engine
from foldyard.sources.sinks import CatalogSink, FanOutSink, ParquetSink, ReportSink

#: Nine readings of three meters: load is exactly 4 + 3 * heat - wind.
READINGS = "heat,wind,meter,load\n" + "".join(
    f"{h},{w},m{i % 3},{4 + 3 * h - w}\n"
    for i, (h, w) in enumerate([(2, 9), (7, 1), (4, 4), (11, 6), (5, 8), (9, 2), (3, 7), (8, 5), (6, 3)])
)


@pytest.fixture
def readings(tmp_path):
    path = tmp_path / "readings.csv"
    path.write_text(READINGS)
    return str(path)


def prepare_config(path, folder):
    return {
        "input": {"path": path},
        "dataset": {"task": "regression", "target": "load"},
        "partition": {"mode": "group", "n_splits": 3, "group_column": "meter"},
        "output": {"dir": str(folder)},
    }


def search(scale=("none",), filters=("none",), reduction=("none",), model=("pls",), **params):
    chosen = {"scale": scale, "filter": filters, "reduction": reduction, "model": model}
    return {
        step: {"enabled": list(keys), "params": {k: params[k] for k in keys if k in params}}
        for step, keys in chosen.items()
    }


def benchmark_config(path, **changes):
    return {
        "input": {
            "source": "external", "data_path": path, "target": "load", "features": ["heat", "wind"],
        },
        "partition": {"n_splits": 3, "random_state": 7},
        "evaluation": {"metrics": ["r2", "neg_mean_absolute_error"], "primary_metric": "r2", "n_jobs": 3},
        "search": search(pls={"n_components": 2}),
        "output": {},
        **changes,
    }


def test_prepare_then_benchmark(spark, readings, tmp_path):
    prepared = fy.prepare(spark, prepare_config(readings, tmp_path / "prep"))
    assert prepared.metadata["rows"] == 9 and prepared.metadata["target"] == "load"
    assert prepared.metadata["partition"]["group_column"] == "meter"
    assert prepared.metadata["columns"] == ["heat", "wind", "meter", "load"]
    assert sorted(r["_row_id"] for r in prepared.data.collect()) == list(range(9))
    folds = spark.read.csv(prepared.paths["folds"], header=True, inferSchema=True)
    assert set(folds.columns) == {"row_id", "fold_id"} and folds.count() == 9

    config = {
        "input": {
            "data_path": prepared.paths["data"],
            "metadata_path": prepared.paths["metadata"],
            "folds_path": prepared.paths["folds"],
        },
        "search": search(
            scale=("none", "std"), reduction=("none", "pca"), model=("pls", "rf"),
            pca={"n_components": 2}, pls={"n_components": 2}, rf={"n_estimators": 4, "max_depth": 2},
        ),
        "output": {"dir": str(tmp_path / "out"), "report": True},
    }
    results = fy.benchmark(spark, config, "regression")
    assert results.detailed.count() == 8 * 3 and results.failed.count() == 0
    first = results.ranking.first()
    assert first["model"] == "pls" and abs(first["neg_root_mean_squared_error"]) < 1e-6
    meta = {r["key"]: r["value"] for r in results.metadata.collect()}
    assert meta["n_experiments"] == "8" and meta["n_success"] == "8"
    for name in ("detailed", "summary", "ranking", "failed", "metadata"):
        assert spark.read.parquet(f"{tmp_path}/out/{name}.parquet").columns
    assert "+-" in spark.read.text(f"{tmp_path}/out/summary.txt").first()[0]

    # Stored folds are used as they are when no fold file is named.
    del config["input"]["folds_path"], config["output"]["dir"]
    again = fy.benchmark(spark, config, "regression")
    order = ["experiment_id", "fold"]
    assert [r["r2"] for r in again.detailed.orderBy(order).collect()] == pytest.approx(
        [r["r2"] for r in results.detailed.orderBy(order).collect()]
    )


def test_hook_runs_before_folds(spark, readings, tmp_path):
    def hook(df, params):
        return df.where(F.col("heat") > params["above"])

    config = prepare_config(readings, tmp_path / "prep")
    config["partition"] = {"n_splits": 2}
    config["hook"] = {"params": {"above": 6}}
    prepared = fy.prepare(spark, config, hook=hook)
    rows = prepared.data.orderBy("_row_id").collect()
    assert [r["heat"] for r in rows] == [7, 11, 9, 8]
    assert [r["_row_id"] for r in rows] == [0, 1, 2, 3]


@pytest.mark.parametrize(
    "change,message",
    [
        (lambda c: c["input"].pop("path"), "'path' is missing"),
        (lambda c: c["input"].update(path="  "), "'path' is missing"),
        (lambda c: c.pop("input"), r"no \[input\] section"),
        (lambda c: c.pop("output"), r"no \[output\] section"),
        (lambda c: c.pop("partition"), r"no \[partition\] section"),
        (lambda c: c["output"].pop("dir"), "'dir' is missing"),
        (lambda c: c["dataset"].update(task="foo"), "Task 'foo'"),
        (lambda c: c["dataset"].update(target="nope"), "no target column 'nope'"),
        (lambda c: c["partition"].pop("group_column"), "need a group column"),
        (lambda c: c.update(hook={"function": "transform"}), "not callable"),
        (lambda c: c.update(hook={"function": lambda df, p: 123}), "no DataFrame"),
    ],
)
def test_prepare_rejects(spark, readings, tmp_path, change, message):
    config = prepare_config(readings, tmp_path / "prep")
    change(config)
    with pytest.raises(ConfigDataError, match=message):
        fy.prepare(spark, config)
    assert not (tmp_path / "prep").exists()


@pytest.mark.parametrize(
    "change,message",
    [
        (lambda c: c["evaluation"].update(n_jobs=0), "n_jobs"),
        (lambda c: c["evaluation"].update(metrics="r2"), "list of names"),
        (lambda c: c["evaluation"].update(metrics=["nope"]), "Unknown regression metrics"),
        (lambda c: c["search"]["model"].update(enabled=["nope"]), "Unknown model technique"),
        (lambda c: c["search"]["model"].update(enabled=[]), "enables no model"),
        (lambda c: c["search"]["model"]["params"].update(pls={"nope": 1}), "Unknown parameters"),
        (lambda c: c["search"]["model"]["params"].update(pls={"n_components": "3:1:1"}), "empty"),
        (lambda c: c["input"].pop("data_path"), "'data_path' is missing"),
        (lambda c: c["input"].update(data_path=" "), "'data_path' is missing"),
        (lambda c: c["input"].update(source="other"), "Input source 'other'"),
        (lambda c: c["input"].update(features=["meter"]), "not numeric"),
        (lambda c: c.pop("output"), r"no \[output\] section"),
        (lambda c: c.pop("search"), r"no \[search\] section"),
        (lambda c: c["search"].pop("scale"), r"no \[scale\] section"),
    ],
)
def test_benchmark_rejects(spark, readings, change, message):
    config = benchmark_config(readings)
    change(config)
    with pytest.raises(ConfigDataError, match=message):
        fy.benchmark(spark, config, "regression")


def test_fold_file_of_the_wrong_length(spark, readings, tmp_path):
    folds = tmp_path / "folds.csv"
    folds.write_text("fold_id\n0\n1\n")
    config = benchmark_config(readings)
    config["input"]["folds_path"] = str(folds)
    with pytest.raises(ConfigDataError, match="folds for 2 rows"):
        fy.benchmark(spark, config, "regression")


def test_task_must_match_the_prepared_one(spark, readings, tmp_path):
    prepared = fy.prepare(spark, prepare_config(readings, tmp_path / "prep"))
    config = benchmark_config(prepared.paths["data"])
    config["input"]["metadata_path"] = prepared.paths["metadata"]
    config["search"] = search(model=("rfc",))
    config["evaluation"] = {}
    with pytest.raises(ConfigDataError, match="prepared data is for regression"):
        fy.benchmark(spark, config, "classification")


def test_default_features_leave_out_group_and_ids(spark, readings):
    config = benchmark_config(readings)
    del config["input"]["features"]
    config["partition"] = {"mode": "group", "n_splits": 3, "group_column": "meter"}
    assert fy.benchmark(spark, config, "regression").detailed.count() == 3


def test_key_columns_replace_row_numbers(spark, readings):
    config = benchmark_config(readings)
    config["input"]["row_key"] = ["meter", "heat"]
    assert fy.benchmark(spark, config, "regression").detailed.count() == 3
    config["input"]["row_key"] = ["nope"]
    with pytest.raises(ConfigDataError, match="Row key"):
        fy.benchmark(spark, config, "regression")


def test_dry_run_counts(spark, readings):
    config = benchmark_config(readings)
    config["search"] = search(
        scale=("none", "std"), reduction=("none", "nmf"), model=("pls", "pls"),
        nmf={"n_components": 1},
    )
    row = fy.benchmark(spark, config, "regression", dry_run=True).first()
    assert (row["data_rows"], row["data_features"], row["n_folds"]) == (9, 2, 3)
    assert row["n_variants_model"] == 2 and row["combinations_total"] == 8
    assert row["combinations_skipped"] == 2 and row["combinations_runnable"] == 6
    assert row["fold_evaluations"] == 18
    assert row["relative_cost"] == pytest.approx(2 * (1 + 1.4 + 1.04))


def test_skipped_failed_and_completed(spark, readings):
    config = benchmark_config(readings)
    config["search"] = search(
        scale=("none", "std"), reduction=("none", "nmf"), model=("pls", "rf"),
        nmf={"n_components": 1, "max_iter": 5}, pls={"n_components": [1, 9]},
        rf={"n_estimators": 2, "max_depth": 31},
    )
    results = fy.benchmark(spark, config, "regression")
    status = {r["experiment_id"]: r for r in results.failed.collect()}
    skipped = [r for r in status.values() if r["status"] == "skipped"]
    failed = [r for r in status.values() if r["status"] == "failed"]
    assert len(skipped) == 3 and all(r["error_type"] == "incompatible_combo" for r in skipped)
    assert all("standardization" in r["reason"] for r in skipped)
    assert all(r["error_type"] == "model_execution" for r in failed)
    assert {r["model"] for r in failed} == {"pls", "rf"} and len(failed) == 6
    done = {r["experiment_id"] for r in results.detailed.collect()}
    assert done.isdisjoint(status) and len(done) + len(status) == 12


def test_negative_data_skips_nmf_and_missing_values_fail(spark, tmp_path):
    path = tmp_path / "neg.csv"
    path.write_text("heat,wind,load\n" + "".join(f"{i - 2},{i},{i}\n" for i in range(9)))
    config = benchmark_config(str(path))
    config["search"] = search(reduction=("nmf", "none"), nmf={"n_components": 1}, pls={"n_components": 1})
    failed = fy.benchmark(spark, config, "regression").failed.collect()
    assert [r["reason"] for r in failed] == ["NMF skipped: input data contains negative values"]
    path.write_text("heat,wind,load\n" + "".join(f"{i},{'' if i == 3 else i},{i}\n" for i in range(9)))
    with pytest.raises(ConfigDataError, match="could be scored"):
        fy.benchmark(spark, config, "regression")


@pytest.mark.parametrize("step", ["_fit_prefix", "_linear", "_score_linear"])
def test_faults_of_the_program_end_the_run(spark, readings, monkeypatch, step):
    def broken(self, *args):
        raise AttributeError("no such thing")

    monkeypatch.setattr(Engine, step, broken)
    with pytest.raises(AttributeError, match="no such thing"):
        fy.benchmark(spark, benchmark_config(readings), "regression")


def test_one_bad_linear_model_fails_alone(spark, readings, monkeypatch):
    whole = Engine._score_linear

    def picky(self, base, models):
        if any(experiment_id == 2 for experiment_id, _ in models):
            raise ModelExecutionError("cannot score the second")
        return whole(self, base, models)

    monkeypatch.setattr(Engine, "_score_linear", picky)
    config = benchmark_config(readings)
    config["search"] = search(scale=("none", "std"), pls={"n_components": 2})
    results = fy.benchmark(spark, config, "regression")
    assert [(r["experiment_id"], r["reason"]) for r in results.failed.collect()] == [(2, "cannot score the second")]
    assert {r["experiment_id"] for r in results.detailed.collect()} == {1}


def test_repeated_row_keys_give_every_fold(spark, readings):
    config = benchmark_config(readings)
    config["input"]["row_key"] = "meter"
    assert fy.benchmark(spark, config, "regression").detailed.count() == 3


def test_combination_without_all_folds_is_failed(spark, readings, monkeypatch):
    whole = Engine._score_linear

    def short(self, base, models):
        return {e: rows[:-1] for e, rows in whole(self, base, models).items()}

    monkeypatch.setattr(Engine, "_score_linear", short)
    with pytest.raises(ConfigDataError, match="2 of 3 folds"):
        fy.benchmark(spark, benchmark_config(readings), "regression")


def test_classification_with_grouped_text_labels(spark, tmp_path):
    path = tmp_path / "c.csv"
    rows = [(i % 7, i % 5, f"p{i % 8}", "yes" if (i % 7) + (i % 5) > 5 else "no") for i in range(80)]
    path.write_text("f1,f2,individual_id,label\n" + "".join(f"{a},{b},{g},{c}\n" for a, b, g, c in rows))
    config = {
        "input": {"source": "external", "data_path": str(path), "target": "label"},
        "partition": {"mode": "group", "n_splits": 4, "group_column": "individual_id"},
        "evaluation": {"metrics": ["f1_macro", "accuracy", "roc_auc", "neg_log_loss"]},
        "search": search(
            filters=("none", "fscore"), model=("logreg", "svc", "rfc", "bagc"),
            fscore={"percentile": 50}, svc={"max_iter": 5, "n_features": 16},
            rfc={"n_estimators": 3, "max_depth": 4}, bagc={"n_estimators": 2, "max_depth": 4},
        ),
        "output": {},
    }
    results = fy.benchmark(spark, config, "classification")
    assert results.failed.isEmpty()
    assert results.detailed.where("model = 'svc' and not neg_log_loss between -1 and 0").isEmpty()
    best = results.ranking.first()
    assert best["filter"] == "none" and best["f1_macro"] > 0.9
    assert results.detailed.where("model = 'logreg' and filter = 'none' and roc_auc < 0.95").isEmpty()
    config["evaluation"] = {"metrics": ["accuracy"], "primary_metric": "accuracy"}
    config["search"] = search(scale=("std",), model=("svc",), svc={"max_iter": 20, "n_features": 64})
    assert fy.benchmark(spark, config, "classification").ranking.first()["accuracy"] > 0.8
    weights = {"class_weight": {"yes": 20}}
    config["search"] = search(model=("logreg", "svc", "rfc"), logreg=weights, svc=weights, rfc={**weights, "max_depth": 3})
    config["evaluation"] = {"metrics": ["recall_macro", "accuracy"], "primary_metric": "accuracy"}
    weighed = fy.benchmark(spark, config, "classification")
    assert weighed.failed.isEmpty() and weighed.detailed.count() == 12
    config["search"] = search(model=("logreg",), logreg={"class_weight": {"maybe": 2}})
    with pytest.raises(ConfigDataError, match="no classes of the target"):
        fy.benchmark(spark, config, "classification")


def test_logistic_gradient_is_zero_at_the_optimum(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from foldyard.operators import mllib

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    frame = spark.createDataFrame(list(zip(y.tolist(), x.tolist())), "y double, x array<double>")
    table = frame.select("y", array_to_vector("x").alias("z"))
    model = mllib.logistic({"C": 2.0, "tol": 1e-10, "max_iter": 500}, 300).fit(table)
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    np.testing.assert_allclose(2.0 * x.T @ (p - y) + w, 0, atol=1e-3)


def test_trees_beat_the_mean_predictor(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("heat,wind,load\n" + "".join(f"{i % 13},{i % 7},{(i % 13) ** 2}\n" for i in range(260)))
    config = benchmark_config(str(path))
    config["search"] = search(
        model=("rf", "bag", "gbr"), rf={"n_estimators": 5}, bag={"n_estimators": 3},
        gbr={"n_estimators": 20, "learning_rate": 0.3},
    )
    results = fy.benchmark(spark, config, "regression")
    assert results.detailed.where("r2 < 0.9").isEmpty() and results.failed.isEmpty()


def _frames(spark):
    combo = [("none", "{}", "none", "{}", "none", "{}", "pls", "{}")]
    rows = [(i, *combo[0], f, float(v)) for i, f, v in
            [(1, 0, 0.9), (1, 1, 0.8), (2, 0, 0.5), (2, 1, "nan"), (3, 0, "nan")]]
    return report.detailed_frame(spark, rows, ["r2"])


def test_summary_ranking_and_formatting(spark):
    detailed = _frames(spark)
    summary = {r["experiment_id"]: r for r in report.summarise(detailed, ["r2"]).collect()}
    assert summary[1]["r2_mean"] == pytest.approx(0.85)
    assert summary[1]["r2_std"] == pytest.approx(0.1 / 2**0.5)
    assert summary[2]["r2_mean"] == 0.5 and summary[2]["r2_std"] is None
    assert [r["experiment_id"] for r in report.rank(detailed, "r2").collect()] == [1, 2, 3]
    text = {r["experiment_id"]: r["r2"] for r in
            report.format_summary(report.summarise(detailed, ["r2"]), ["r2"]).collect()}
    assert text == {1: "0.8500 +- 0.0707", 2: "0.5000 +- nan", 3: "nan +- nan"}
    lines = report.text_lines(report.format_ranking(report.rank(detailed, "r2"), "r2")).collect()
    assert [r["rank"] for r in report.rank(detailed, "r2").collect()] == [1, 2, 3]
    assert lines[0][0].endswith("pls & {} & 0.8500")


def test_failed_rows_get_a_type(spark):
    frame = spark.createDataFrame([("skipped",), ("Failed",), ("odd",)], "status string")
    got = {r["status"]: r["error_type"] for r in report.normalise_failed(frame).collect()}
    assert got == {
        "skipped": "incompatible_combo", "Failed": "model_execution", "odd": "internal",
    }


def test_sinks_write_and_report_paths(spark, readings, tmp_path):
    class Spy:
        calls = 0

        def write(self, results):
            Spy.calls += 1
            return ["spy"]

    folder = str(tmp_path / "sink")
    sink = FanOutSink((ParquetSink(folder), ReportSink(folder), Spy(), CatalogSink("run")))
    written = []

    class Keep:
        def write(self, results):
            written.extend(sink.write(results))
            return written

    fy.benchmark(spark, copy.deepcopy(benchmark_config(readings)), "regression", sink=Keep())
    assert Spy.calls == 1 and len(written) == 5 + 2 + 1 + 5
    assert written[5].endswith("ranking.txt") and written[7] == "spy"
    assert spark.table("run_ranking").count() == 1


def progress_experiments():
    from foldyard.plans.experiments import expand

    return expand("regression", {"search": search(scale=("none", "std"), model=("pls",), pls={"n_components": [1, 2, 9]})})


def test_a_stopped_run_ends_with_the_same_tables(spark, readings, tmp_path, monkeypatch):
    """Killed after the second batch; what had ended is not run again."""
    from foldyard.plans import engine, progress

    monkeypatch.setattr(progress, "BATCH", 2)
    config = benchmark_config(readings)
    config["search"] = search(scale=("none", "std"), model=("pls",), pls={"n_components": [1, 2, 9]})
    whole = fy.benchmark(spark, config, "regression")
    config["output"] = {"resume": str(tmp_path / "progress")}
    run, seen = engine.Engine.run, []

    def stopped(self, experiments):
        if len(seen) == 4:
            raise KeyboardInterrupt
        seen.extend(e.experiment_id for e in experiments)
        return run(self, experiments)

    monkeypatch.setattr(engine.Engine, "run", stopped)
    with pytest.raises(KeyboardInterrupt):
        fy.benchmark(spark, config, "regression")
    monkeypatch.setattr(engine.Engine, "run", lambda self, es: (seen.extend(e.experiment_id for e in es), run(self, es))[1])
    resumed = fy.benchmark(spark, config, "regression")
    assert sorted(seen) == [1, 2, 3, 4, 5, 6]  # each once
    for name in ("detailed", "failed", "ranking"):
        rows = lambda r: sorted(map(str, getattr(r, name).collect()))  # noqa: E731, B023
        assert rows(resumed) == rows(whole)
    config["evaluation"] = {"metrics": ["neg_mean_absolute_error"], "primary_metric": "neg_mean_absolute_error"}
    assert fy.benchmark(spark, config, "regression").detailed.count() == whole.detailed.count()
    assert len(seen) == 12  # another run in the same folder


def test_registered_techniques(spark, readings):
    from pyspark.ml.regression import DecisionTreeRegressor

    from foldyard.plans import registry

    with pytest.raises(ConfigDataError, match="exists"):
        fy.register("regression", "model", "pls", lambda: None)
    with pytest.raises(ConfigDataError, match="task"):
        fy.register("ranking", "model", "tree", lambda: None)
    before = registry.TECHNIQUES["regression"]["model"]
    try:
        fy.register("regression", "model", "tree", lambda depth: DecisionTreeRegressor(featuresCol="z", labelCol="y", maxDepth=depth), ["depth"])
        config = benchmark_config(readings)
        config["search"] = search(scale=("std",), model=("tree",), tree={"depth": [1, 3]})
        assert fy.benchmark(spark, config, "regression").ranking.count() == 2
        config["search"] = search(model=("tree",), tree={"height": 1})
        with pytest.raises(ConfigDataError, match="Unknown parameters"):
            fy.benchmark(spark, config, "regression")
    finally:
        registry.TECHNIQUES["regression"]["model"] = before
        registry.ADDED.clear()
