"""Writers: prepared artifacts, result tables, report text."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import FOLD_ID
from ..operators.rowid import ROW_ID
from ..plans.report import Results, format_ranking, format_summary, text_lines
from .tables import METADATA_SCHEMA


class Sink(Protocol):
    """Anything that stores the tables of a run and says where."""

    def write(self, results: Results) -> list[str]: ...


@dataclass(frozen=True)
class ParquetSink:
    """One Parquet folder per result table."""

    directory: str

    def write(self, results: Results) -> list[str]:
        written = []
        for name, table in results.tables().items():
            path = f"{self.directory}/{name}.parquet"
            table.write.mode("overwrite").parquet(path)
            written.append(path)
        return written


@dataclass(frozen=True)
class CatalogSink:
    """One managed table per result table, named ``prefix_table``."""

    prefix: str

    def write(self, results: Results) -> list[str]:
        written = []
        for name, table in results.tables().items():
            table.write.mode("overwrite").saveAsTable(f"{self.prefix}_{name}")
            written.append(f"{self.prefix}_{name}")
        return written


@dataclass(frozen=True)
class ReportSink:
    """Ranking and summary as text lines with fixed decimals."""

    directory: str

    def write(self, results: Results) -> list[str]:
        tables = {
            "ranking": format_ranking(results.ranking, results.primary_metric),
            "summary": format_summary(results.summary, results.metrics),
        }
        written = []
        for name, table in tables.items():
            path = f"{self.directory}/{name}.txt"
            text_lines(table).write.mode("overwrite").text(path)
            written.append(path)
        return written


@dataclass(frozen=True)
class FanOutSink:
    """Writes to several sinks; returns all paths in order."""

    sinks: tuple[Sink, ...]

    def write(self, results: Results) -> list[str]:
        return [path for sink in self.sinks for path in sink.write(results)]


def save_prepared(directory: str, data: DataFrame, metadata: dict[str, Any]) -> dict[str, str]:
    """Write data (with row and fold ids), folds as CSV and Parquet, and metadata.

    The fold tables are read back from the written data, so folds are assigned once.
    """
    spark = data.sparkSession
    paths = {
        "data": f"{directory}/data.parquet",
        "folds": f"{directory}/folds.csv",
        "folds_parquet": f"{directory}/folds.parquet",
        "metadata": f"{directory}/metadata.json",
    }
    data.write.mode("overwrite").parquet(paths["data"])
    stored = spark.read.parquet(paths["data"])
    folds = stored.select(F.col(ROW_ID).alias("row_id"), FOLD_ID)
    folds.write.mode("overwrite").parquet(paths["folds_parquet"])
    folds.write.mode("overwrite").csv(paths["folds"], header=True)
    full = {**metadata, "rows": stored.count()}
    spark.createDataFrame([full], METADATA_SCHEMA).coalesce(1).write.mode("overwrite").json(
        paths["metadata"]
    )
    return paths
