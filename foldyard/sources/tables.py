"""Readers: data tables, fold tables and prepared metadata."""

from __future__ import annotations

from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigDataError
from ..operators.folds import FOLD_ID, dense_fold_index
from ..operators.rowid import ROW_ID, ingest_row_ids, rank_rows

METADATA_SCHEMA = (
    "created_at string, source_data string, target string, task string, "
    "partition struct<mode:string,n_splits:int,shuffle:boolean,random_state:long,"
    "group_column:string>, rows long, columns array<string>"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    try:
        return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    except Py4JJavaError as exc:
        raise ConfigDataError(f"Cannot open {path}: {exc.java_exception}") from exc


def _require_path(spark: SparkSession, path: str, what: str) -> None:
    if not path_exists(spark, path):
        raise ConfigDataError(f"{what} not found: {path}")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (with header) or Parquet, by suffix; files or directories.

    Give ``schema`` for large CSV input: without it Spark reads the data once more to
    infer the types.
    """
    suffix = path.rstrip("/").lower()
    _require_path(spark, path, "Data file")
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        if suffix.endswith(".csv"):
            return reader.csv(path, header=True, inferSchema=schema is None)
        if suffix.endswith(".parquet"):
            return reader.parquet(path)
    except AnalysisException as exc:
        raise ConfigDataError(f"Cannot read {path}: {exc}") from exc
    raise ConfigDataError(f"Unsupported data format: {path}")


def read_folds(spark: SparkSession, path: str, expected_rows: int) -> DataFrame:
    """(_row_id, fold_id) from ``row_id,fold_id``, ``fold_id`` or any single column.

    Rows are identified by the *order* of ``row_id``, or by file order without it.
    """
    _require_path(spark, path, "Folds file")
    folds = read_table(spark, path)
    if FOLD_ID not in folds.columns:
        if len(folds.columns) != 1:
            raise ConfigDataError(f"{path}: of several columns one must be named {FOLD_ID}")
        folds = folds.withColumnRenamed(folds.columns[0], FOLD_ID)
    if "row_id" in folds.columns:
        found, low, high, distinct = folds.agg(
            F.count("*"), F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")
        ).first()
        dense = (low, high, distinct) == (0, found - 1, found)
        if dense:
            folds = folds.withColumnRenamed("row_id", ROW_ID)
        else:
            folds = rank_rows(folds, ["row_id"])
    else:
        folds = ingest_row_ids(folds)
        found = folds.count()
    if found != expected_rows:
        raise ConfigDataError(
            f"{path} has folds for {found} rows, the data has {expected_rows}"
        )
    return folds.select(F.col(ROW_ID).cast("long"), F.col(FOLD_ID).cast("int"))


def read_metadata(spark: SparkSession, path: str | None) -> dict[str, Any]:
    """The metadata row as a dictionary; empty without a path."""
    if not path:
        return {}
    _require_path(spark, path, "Metadata file")
    row = spark.read.schema(METADATA_SCHEMA).json(path, multiLine=True).first()
    return row.asDict(recursive=True) if row else {}


def align_folds(data: DataFrame, folds: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Give each row its fold and the fold's place among the sorted fold ids (``fold``).

    Rows without a fold and folds without a row drop out; ``Dataset`` compares the rows
    left with the rows expected in its first aggregate.
    """
    return data.drop(FOLD_ID).join(dense_fold_index(folds), row_id)


def project(df: DataFrame, target: str, features: list[str] | None, skip: list[str] = ()) -> list[str]:
    """The feature columns: those given, or all but the target and ``skip``."""
    if not target or target not in df.columns:
        raise ConfigDataError(f"No target column: {target!r} is not in the data")
    if features is None:
        features = [c for c in df.columns if c != target and c not in skip]
    if not isinstance(features, list) or not features:
        raise ConfigDataError("Features are a list with at least one column name")
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ConfigDataError(f"The data has no columns {missing}, which are named as features")
    return [str(c) for c in features]


def drop_missing_target(df: DataFrame, params: dict[str, Any]) -> DataFrame:
    """Ready-made transform: drop rows whose target is null or NaN."""
    target = str(params.get("target_column", "target"))
    if params.get("drop_na_target") and target in df.columns:
        df = df.na.drop(subset=[target])  # drops NaN as well as null
    return df
