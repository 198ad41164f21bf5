"""Public entry points: prepare, plan and benchmark, each driven by a dictionary."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from typing import Any, Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigDataError
from ..functions.metrics import check_metrics
from ..functions.params import resolve_metrics
from ..operators.folds import FOLD_ID, PartitionSpec, assign_folds, dense_fold_index
from ..operators.rowid import ROW_ID, ingest_row_ids, rank_rows
from ..sources.sinks import FanOutSink, ParquetSink, ReportSink, Sink, save_prepared
from ..sources.tables import align_folds, project, read_folds, read_metadata, read_table
from .dataset import Dataset, check_numeric, spread_arrays
from .engine import Engine
from .progress import Progress
from .experiments import (
    Experiment,
    expand,
    experiments_frame,
    plan_summary,
    section,
    variants,
    with_cost,
    with_validity,
)
from .registry import STEPS
from .report import Results, build_results

TASKS = ("regression", "classification")
SOURCES = ("prepared", "external")
DEFAULT_PARALLELISM = 4
Hook = Callable[[DataFrame, dict[str, Any]], DataFrame]


@dataclass(frozen=True)
class Prepared:
    """Data with ``_row_id`` and ``fold_id``, its metadata, and where it was written."""

    data: DataFrame
    metadata: dict[str, Any]
    paths: dict[str, str]


def _require(*conditions: tuple[Any, str]) -> None:
    """Raise for the first condition that does not hold."""
    for holds, problem in conditions:
        if not holds:
            raise ConfigDataError(problem)


def _text(settings: dict[str, Any], key: str) -> str:
    """A setting that must be a text with something in it."""
    value = settings.get(key)
    _require((value is not None and str(value).strip(), f"Setting {key!r} is missing or blank"))
    return str(value)


def _key_columns(source: dict[str, Any], columns: list[str]) -> list[str]:
    """Columns of ``row_key``, a name or a list of names; empty when absent."""
    key = source.get("row_key") or []
    key = [key] if isinstance(key, str) else list(key)
    unknown = sorted(set(key) - set(columns))
    _require((not unknown, f"Row key columns {unknown} are not in the data"))
    return key


def _numbered(data: DataFrame, key: list[str]) -> DataFrame:
    """Row ids 0..n-1: by the given key, else by the ids the rows were read with."""
    if key:
        return rank_rows(data.drop(ROW_ID), key)
    if ROW_ID not in data.columns:  # the hook built new rows
        return rank_rows(data, data.columns)
    rows, last = data.agg(F.count("*"), F.max(ROW_ID)).first()
    if rows and last != rows - 1:  # the hook dropped rows
        return rank_rows(data.withColumnRenamed(ROW_ID, "_read_id"), ["_read_id"]).drop("_read_id")
    return data


@dataclass(frozen=True)
class _Preparation:
    """A checked configuration of ``prepare``."""

    source: dict[str, Any]
    path: str
    task: str
    target: str | None
    spec: PartitionSpec
    hook: Hook | None
    hook_params: dict[str, Any]
    folder: str

    @classmethod
    def of(cls, config: dict[str, Any], hook: Hook | None) -> "_Preparation":
        source, output, partition = (section(config, s) for s in ("input", "output", "partition"))
        dataset, transform = config.get("dataset") or {}, config.get("hook") or {}
        hook = hook or transform.get("function")
        task = dataset.get("task", TASKS[0])
        _require(
            (task in TASKS, f"Task {task!r} is none of {', '.join(TASKS)}"),
            (hook is None or callable(hook), f"The transform hook {hook!r} is not callable"),
        )
        return cls(
            source=source,
            path=_text(source, "path"),
            task=task,
            target=dataset.get("target"),
            spec=PartitionSpec.from_config(partition),
            hook=hook,
            hook_params=transform.get("params", {}),
            folder=_text(output, "dir"),
        )

    def rows(self, spark: SparkSession) -> DataFrame:
        """The table after the hook, with row ids where no key columns are named."""
        data = read_table(spark, self.path, self.source.get("schema"))
        if ROW_ID not in data.columns and not self.source.get("row_key"):
            data = ingest_row_ids(data)
        if self.hook is not None:
            data = self.hook(data, self.hook_params)
        _require(
            (isinstance(data, DataFrame), f"The transform hook gave back {data!r}, no DataFrame"),
            (self.target in getattr(data, "columns", ()), f"The data has no target column {self.target!r}"),
        )
        return data

    def facts(self, columns: list[str]) -> dict[str, Any]:
        """What is stored next to the data; its field names are fixed values."""
        return {
            "task": self.task,
            "target": self.target,
            "columns": columns,
            "partition": asdict(self.spec),
            "source_data": self.path,
            "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
        }


def prepare(spark: SparkSession, config: dict[str, Any], hook: Hook | None = None) -> Prepared:
    """Read, transform, give every row a fold, and write data, folds and metadata to
    the folder of ``[output].dir``."""
    run = _Preparation.of(config, hook)
    rows = run.rows(spark).drop(FOLD_ID)
    facts = run.facts([c for c in rows.columns if c != ROW_ID])
    numbered = _numbered(rows, _key_columns(run.source, rows.columns))
    folded = assign_folds(numbered, run.task, run.spec, run.target)
    paths = save_prepared(run.folder, folded, facts)
    return Prepared(spark.read.parquet(paths["data"]), read_metadata(spark, paths["metadata"]), paths)


def _ids_for_rows(data: DataFrame, key: list[str], from_file: bool) -> DataFrame:
    """Row ids, from file positions where rows come straight from a file."""
    if not key and ROW_ID in data.columns:
        return data
    return ingest_row_ids(data) if from_file and not key else _numbered(data, key)


def _folded(
    data: DataFrame, source: dict[str, Any], task: str, target: str, spec: PartitionSpec, from_file: bool
) -> tuple[DataFrame, int | None]:
    """The rows with ``fold``: of a fold file, stored with them, or assigned now; and
    how many rows must have found a fold, where that is to be checked."""
    key = _key_columns(source, data.columns)
    if source.get("folds_path"):
        data = _ids_for_rows(data, key, from_file)
        rows = data.count()
        return align_folds(data, read_folds(data.sparkSession, str(source["folds_path"]), rows)), rows
    if {FOLD_ID, ROW_ID} <= set(data.columns):
        return dense_fold_index(data), None
    data = data.drop(FOLD_ID)
    row_id: str | list[str] = ROW_ID
    if spec.mode == "random":  # groups need no row ids
        if key and spec.shuffle:
            row_id = key  # hashed as they are
        else:
            data = _ids_for_rows(data, key, from_file)
    return assign_folds(data, task, spec, target, row_id).withColumnRenamed(FOLD_ID, "fold"), None


@dataclass(frozen=True)
class _Opened:
    """The rows of a run before folds, and what the configuration says of them."""

    data: DataFrame
    source: dict[str, Any]
    target: str
    features: list[str]
    spec: PartitionSpec
    from_file: bool

    @classmethod
    def of(
        cls, spark: SparkSession, config: dict[str, Any], task: str, data: DataFrame | None
    ) -> "_Opened":
        source = section(config, "input")
        kind = source.get("source", SOURCES[0])
        _require((kind in SOURCES, f"Input source {kind!r} is none of {', '.join(SOURCES)}"))
        from_file = data is None
        if data is None:
            data = read_table(spark, _text(source, "data_path"), source.get("schema"))
        stored = read_metadata(spark, source.get("metadata_path"))
        made_for = stored.get("task") or task
        _require((made_for == task, f"The prepared data is for {made_for}, this run is for {task}"))
        target = source.get("target") or stored.get("target")
        spec = PartitionSpec.from_config(config.get("partition", {}))
        group = spec.group_column or (stored.get("partition") or {}).get("group_column")
        features = project(data, target, source.get("features"), [ROW_ID, FOLD_ID, group])
        data, features = spread_arrays(data, features)
        return cls(data, source, target, features, spec, from_file)

    @property
    def has_folds(self) -> bool:
        return bool(self.source.get("folds_path")) or {FOLD_ID, ROW_ID} <= set(self.data.columns)

    def dataset(self, task: str) -> Dataset:
        folded, expected = _folded(self.data, self.source, task, self.target, self.spec, self.from_file)
        return Dataset.build(folded, self.features, self.target, task, "fold", expected)

    def size(self, task: str) -> tuple[int, int, bool]:
        """(rows, folds, whether a feature is negative), of given folds from the dataset,
        else from one aggregate, as the number of folds to make is known."""
        if self.has_folds:
            dataset = self.dataset(task)
            found = dataset.profile
            dataset.release()
            return found.rows, found.folds, found.any_negative
        check_numeric(self.data, self.features, self.target, task)
        values = [F.col(c).cast("double") for c in self.features]
        lowest = F.least(*values) if len(values) > 1 else values[0]
        rows, negative = self.data.agg(F.count("*"), F.bool_or(lowest < 0)).first()
        k = self.spec.n_splits
        _require((k <= rows, f"Cannot make {k} folds of {rows} rows"))
        return rows, k, bool(negative)


def _checked(config: dict[str, Any], task: str):
    """Everything that can be rejected before a job runs."""
    _require((task in TASKS, f"Task {task!r} is none of {', '.join(TASKS)}"))
    section(config, "input")
    section(config, "output")
    evaluation = config.get("evaluation", {})
    metrics, primary = resolve_metrics(task, evaluation)
    check_metrics(task, metrics)
    n_jobs = int(evaluation.get("n_jobs", -1))
    _require((n_jobs == -1 or n_jobs > 0, f"n_jobs is {n_jobs}; give a positive number, or -1"))
    parallelism = DEFAULT_PARALLELISM if n_jobs == -1 else n_jobs
    return metrics, primary, parallelism, expand(task, config)


def plan(
    spark: SparkSession, config: dict[str, Any], task: str, data: DataFrame | None = None
) -> DataFrame:
    """What a run would do, as one row; reads the data, trains nothing."""
    *_, experiments = _checked(config, task)
    opened = _Opened.of(spark, config, task, data)
    rows, folds, negative = opened.size(task)
    frame = with_cost(with_validity(experiments_frame(spark, experiments), F.lit(negative)))
    counts = variants(task, section(config, "search"))
    return plan_summary(frame).select(
        F.lit(task).alias("task"),
        F.lit(rows).cast("long").alias("data_rows"),
        F.lit(len(opened.features)).alias("data_features"),
        F.lit(folds).alias("n_folds"),
        *[F.lit(len(counts[step])).alias(f"n_variants_{step}") for step in STEPS],
        "*",
        (F.col("combinations_runnable") * folds).alias("fold_evaluations"),
    )


def run_experiments(
    spark: SparkSession,
    dataset: Dataset,
    task: str,
    experiments: list[Experiment],
    metrics: list[str],
    primary: str,
    parallelism: int = DEFAULT_PARALLELISM,
    facts: dict[str, Any] | None = None,
    progress: Progress | None = None,
) -> Results:
    """Fit and score the experiments and shape the result relations.

    With ``progress`` they run a few at a time; each few's rows are appended to its table,
    and experiments whose rows it has are not run again.
    """
    engine = Engine(dataset, task, metrics, parallelism)
    if progress is None:
        detailed, failed = engine.run(experiments)
    else:
        profile = dataset.profile
        run = progress.named([task, metrics, profile.rows, profile.folds, dataset.d, list(map(str, dataset.classes))])
        detailed, failed = run.complete(engine, experiments)
    known = {
        "task": task,
        "primary_metric": primary,
        "metrics": ",".join(metrics),
        "spark_parallelism": parallelism,
        **(facts or {}),
    }
    return build_results(spark, detailed, failed, metrics, primary, len(experiments), known)


def benchmark(
    spark: SparkSession,
    config: dict[str, Any],
    task: str,
    data: DataFrame | None = None,
    sink: Sink | None = None,
    dry_run: bool = False,
) -> Results | DataFrame:
    """Run the configured comparison; with ``dry_run`` return its plan instead.

    With ``[output].resume`` finished experiments are kept in that folder as they end, and
    a run that was stopped continues from there; the folder serves any number of runs,
    told apart by input, metrics and data size.

    ``data`` replaces ``[input].data_path``. Results go to ``sink``, or to
    ``[output].dir`` when that is set (plus text tables with ``report = true``).
    """
    if dry_run:
        return plan(spark, config, task, data)
    metrics, primary, parallelism, experiments = _checked(config, task)
    output = section(config, "output")
    dataset = _Opened.of(spark, config, task, data).dataset(task)
    try:
        results = run_experiments(
            spark, dataset, task, experiments, metrics, primary, parallelism,
            {"report_enabled": bool(output.get("report", False))},
            Progress(spark, str(output["resume"]), section(config, "input")) if output.get("resume") else None,
        )
    finally:
        dataset.release()
    if sink is None and output.get("dir"):
        sinks: list[Sink] = [ParquetSink(str(output["dir"]))]
        if output.get("report"):
            sinks.append(ReportSink(str(output.get("report_dir") or output["dir"])))
        sink = FanOutSink(tuple(sinks))
    if sink is not None:
        sink.write(results)
    return results
