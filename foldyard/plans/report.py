"""Result relations: summary, ranking, failures, run metadata, formatted tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import INCOMPATIBLE_COMBO, INTERNAL, MODEL_EXECUTION, ConfigDataError
from .experiments import COMBO_COLUMNS, COMBO_SCHEMA

FAILED_SCHEMA = f"{COMBO_SCHEMA}, status string, error_type string, reason string"
FORMAT_DECIMALS = 4


@dataclass(frozen=True)
class Results:
    """The five tables of a run."""

    detailed: DataFrame
    summary: DataFrame
    ranking: DataFrame
    failed: DataFrame
    metadata: DataFrame
    primary_metric: str
    metrics: list[str]

    def tables(self) -> dict[str, DataFrame]:
        names = ("detailed", "summary", "ranking", "failed", "metadata")
        return {name: getattr(self, name) for name in names}


def detailed_frame(spark: SparkSession, rows: list[tuple], metrics: list[str]) -> DataFrame:
    columns = ", ".join(f"`{m}` double" for m in metrics)
    return spark.createDataFrame(rows, f"{COMBO_SCHEMA}, fold int, {columns}")


def failed_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, FAILED_SCHEMA)


def append(*frames: DataFrame) -> DataFrame:
    """Rows of several runs as one relation, matched by column name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def _value(metric: str) -> Column:
    """The metric with NaN treated as missing."""
    return F.when(~F.isnan(metric), F.col(metric))


def summarise(detailed: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of every metric per combination."""
    aggregates = []
    for m in metrics:
        aggregates += [
            F.avg(_value(m)).alias(f"{m}_mean"),
            F.stddev_samp(_value(m)).alias(f"{m}_std"),
        ]
    return detailed.groupBy(*COMBO_COLUMNS).agg(*aggregates)


def rank(detailed: DataFrame, primary: str) -> DataFrame:
    """Combinations from best (``rank`` 1) to worst mean of the primary metric.

    Combinations without a value come last; ties go by experiment id.
    """
    means = detailed.groupBy(*COMBO_COLUMNS).agg(F.avg(_value(primary)).alias(primary))
    order = [F.desc_nulls_last(primary), F.col("experiment_id")]
    # One row per combination of the search space: a single window holds them all.
    return means.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy("rank")


def normalise_failed(failed: DataFrame) -> DataFrame:
    """Fill ``error_type`` from ``status`` where it is absent."""
    status = F.lower("status")
    inferred = (
        F.when(status == "skipped", INCOMPATIBLE_COMBO)
        .when(status == "failed", MODEL_EXECUTION)
        .otherwise(INTERNAL)
    )
    given = F.col("error_type") if "error_type" in failed.columns else F.lit(None)
    return failed.withColumn("error_type", F.coalesce(given, inferred))


def run_metadata(
    detailed: DataFrame, failed: DataFrame, n_experiments: int, facts: dict[str, Any]
) -> DataFrame:
    """Key/value rows: the given facts, then counts of experiments."""
    spark = detailed.sparkSession
    given = spark.createDataFrame(
        [(k, str(v)) for k, v in facts.items()] + [("n_experiments", str(n_experiments))],
        "key string, value string",
    )
    success = detailed.agg(
        F.lit("n_success").alias("key"),
        F.count_distinct("experiment_id").cast("string").alias("value"),
    )
    lost = failed.agg(
        F.lit("n_failed_or_skipped").alias("key"), F.count("*").cast("string").alias("value")
    )
    return append(given, success, lost)


def build_results(
    spark: SparkSession,
    detailed_rows: list[tuple],
    failed_rows: list[tuple],
    metrics: list[str],
    primary: str,
    n_experiments: int,
    facts: dict[str, Any],
) -> Results:
    if not detailed_rows:
        reasons = "; ".join(sorted({str(row[-1]) for row in failed_rows}))
        raise ConfigDataError(
            f"No combination of the search space could be scored: {reasons}".rstrip(": ")
        )
    detailed = detailed_frame(spark, detailed_rows, metrics)
    failed = normalise_failed(failed_frame(spark, failed_rows))
    return Results(
        detailed=detailed,
        summary=summarise(detailed, metrics),
        ranking=rank(detailed, primary),
        failed=failed,
        metadata=run_metadata(detailed, failed, n_experiments, facts),
        primary_metric=primary,
        metrics=metrics,
    )


def _fixed(value: Column, decimals: int = FORMAT_DECIMALS) -> Column:
    """Fixed-decimals text; a missing value reads ``nan``."""
    text = F.format_string(f"%.{decimals}f", value)
    return F.when(value.isNull() | F.isnan(value), "nan").otherwise(text)


def format_summary(
    summary: DataFrame, metrics: list[str], decimals: dict[str, int] | None = None
) -> DataFrame:
    """Combination columns and one ``mean +- std`` text per metric, with the decimals
    given for it (else four)."""
    cells = []
    for m in metrics:
        places = (decimals or {}).get(m, FORMAT_DECIMALS)
        mean, deviation = (_fixed(F.col(f"{m}_{x}"), places) for x in ("mean", "std"))
        cells.append(F.concat(mean, F.lit(" +- "), deviation).alias(m))
    return summary.select(*COMBO_COLUMNS, *cells)


def format_ranking(ranking: DataFrame, primary: str) -> DataFrame:
    """The ranking with its metric as fixed-decimals text."""
    return ranking.drop("rank").withColumn(primary, _fixed(F.col(primary)))


def text_lines(table: DataFrame) -> DataFrame:
    """Rows of a formatted table as single text lines."""
    cells = [F.col(c).cast("string") for c in table.columns]
    return table.select(F.concat_ws(" & ", *cells).alias("value"))
