"""The fold-tagged numeric table all experiments of a run read."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from ..errors import ConfigDataError
from ..operators.features import row_norm
from ..operators.folds import MAX_CLASSES
from ..operators.moments import (
    SQL_COLUMNS,
    Moments,
    fold_moments_columns,
    fold_moments_design,
    train_moments,
)
from ..operators.sums import in_blocks


@dataclass(frozen=True)
class Profile:
    """One aggregate over the cached table."""

    rows: int
    folds: int
    any_negative: bool
    any_missing: bool
    mean: np.ndarray


def spread_arrays(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Array and vector feature columns as one scalar column for each place.

    All rows must have arrays of one length; null arrays count as missing values. One
    aggregate reads the lengths. Other features stay as they are.
    """
    wide = {}
    for name in features:
        kind = df.schema[name].dataType
        if isinstance(kind, VectorUDT):
            wide[name] = vector_to_array(name)
        elif isinstance(kind, T.ArrayType):
            wide[name] = F.col(name)
    if not wide:
        return df, features
    lengths = df.agg(*[f(F.when(c.isNotNull(), F.size(c))) for c in wide.values() for f in (F.min, F.max)]).first()
    spread: dict[str, list[str]] = {}
    columns = {}
    for i, (name, values) in enumerate(wide.items()):
        low, high = lengths[2 * i], lengths[2 * i + 1]
        if not low or low != high:
            raise ConfigDataError(f"Arrays of {name!r} have from {low} to {high} values; one length is needed")
        spread[name] = [f"{name}_{j}" for j in range(high)]
        columns |= {column: F.get(values, F.lit(j)) for j, column in enumerate(spread[name])}
    taken = sorted(set(columns) & set(df.columns))
    if taken:
        raise ConfigDataError(f"Columns {taken} are in the way of the places of an array feature")
    return df.withColumns(columns), [c for name in features for c in spread.get(name, [name])]


def check_numeric(df: DataFrame, features: list[str], target: str, task: str) -> None:
    """Features, and a regression target, must be numbers or booleans."""
    for name in [*features, target] if task == "regression" else features:
        if not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)):
            raise ConfigDataError(f"Column '{name}' is not numeric")


@dataclass
class Dataset:
    """Columns ``fold`` int, ``y`` double and ``x0..`` double, cached for the run."""

    df: DataFrame
    d: int
    classes: list = field(default_factory=list)
    expected_rows: int | None = None
    cached: DataFrame | None = None

    @classmethod
    def build(
        cls,
        df: DataFrame,
        features: list[str],
        target: str,
        task: str,
        fold: str,
        expected_rows: int | None = None,
    ) -> "Dataset":
        """Project, cast and index ``df``; nothing but the needed columns is kept."""
        check_numeric(df, features, target, task)
        wanted = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
        fold_column = F.col(fold).cast("int").alias("fold")
        y = F.col(target).cast("double") if task == "regression" else F.col(target)
        cached = df.select(fold_column, y.alias("y"), *wanted).persist(
            StorageLevel.MEMORY_AND_DISK
        )
        if task == "regression":
            return cls(cached, len(features), [], expected_rows, cached)
        # The labels come from the cached table, so the input is read once.
        found = cached.select("y").distinct().limit(MAX_CLASSES + 1).collect()
        if len(found) > MAX_CLASSES:
            cached.unpersist()
            raise ConfigDataError(f"Target '{target}' has over {MAX_CLASSES} values, too many for classes")
        classes = sorted(r[0] for r in found if r[0] is not None)
        labels = df.sparkSession.createDataFrame(
            [(label, float(i)) for i, label in enumerate(classes)],
            T.StructType(
                [
                    T.StructField("_label", df.schema[target].dataType),
                    T.StructField("_index", T.DoubleType()),
                ]
            ),
        )
        names = [f"x{i}" for i in range(len(features))]
        # One row per class, MAX_CLASSES at most.
        indexed = cached.join(F.broadcast(labels), F.col("y") == F.col("_label"), "left")
        table = indexed.select("fold", F.col("_index").alias("y"), *names)
        return cls(table, len(features), classes, expected_rows, cached)

    def release(self) -> None:
        """Drop the cached table."""
        self.release_blocks()
        if self.cached is not None:
            self.cached.unpersist()

    def release_blocks(self) -> None:
        """Drop the cached blocks; they are made again when needed."""
        blocks = self.__dict__.pop("blocks", None)
        if blocks is not None:
            blocks.unpersist()

    @property
    def names(self) -> list[str]:
        return [f"x{i}" for i in range(self.d)]

    @cached_property
    def profile(self) -> Profile:
        names = self.names
        missing = F.col("y").isNull() | F.isnan("y")
        for name in names:
            missing = missing | F.col(name).isNull() | F.isnan(name)
        lowest = F.least(*names) if self.d > 1 else F.col(names[0])
        row = self.df.agg(
            F.count("*"),
            F.coalesce(F.max("fold") + 1, F.lit(0)),
            F.coalesce(F.bool_or(lowest < 0), F.lit(False)),
            F.coalesce(F.bool_or(missing), F.lit(False)),
            *[F.avg(c) for c in [*names, "y"]],
        ).first()
        if self.expected_rows is not None and row[0] != self.expected_rows:
            raise ConfigDataError(
                f"The folds fit {row[0]} rows, the data has {self.expected_rows}"
            )
        mean = np.array([0.0 if v is None else v for v in row[4:]])
        return Profile(row[0], row[1], row[2], row[3], mean)

    def fold_sizes(self) -> DataFrame:
        """fold, n_test (its rows) and n_train (all other rows); one row per fold."""
        sizes = self.df.groupBy("fold").agg(F.count("*").alias("n_test"))
        whole = F.sum("n_test").over(Window.partitionBy())
        return sizes.withColumn("n_train", whole - F.col("n_test"))

    @property
    def k(self) -> int:
        return self.profile.folds

    def normalised(self, norm: str) -> "Dataset":
        """The same rows with each feature divided by the row norm."""
        columns = row_norm([F.col(c) for c in self.names], norm)
        table = self.df.select("fold", "y", *[c.alias(n) for c, n in zip(columns, self.names)])
        return Dataset(table, self.d, self.classes)

    @cached_property
    def design(self) -> DataFrame:
        return self.df.select("fold", "y", F.array(*self.names).alias("x"))

    @cached_property
    def blocks(self) -> DataFrame:
        """The design table as estimators of many passes read it, cached."""
        return in_blocks(self.design).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def fold_moments(self) -> list[Moments]:
        if self.d < SQL_COLUMNS:
            return fold_moments_columns(self.df, self.names, "y", self.k)
        return fold_moments_design(self.design, self.k, self.profile.mean)

    @cached_property
    def train_moments(self) -> list[Moments]:
        return train_moments(self.fold_moments)

    @cached_property
    def class_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows per (fold, class), and centred feature sums per (fold, class, feature)."""
        centre = self.profile.mean[:-1]
        rows = (
            self.df.groupBy("fold", "y")
            .agg(
                F.count("*"),
                *[F.sum(F.col(c) - F.lit(float(m))) for c, m in zip(self.names, centre)],
            )
            .collect()
        )
        n = np.zeros((self.k, len(self.classes)))
        sums = np.zeros((self.k, len(self.classes), self.d))
        for row in rows:
            n[row[0], int(row[1])] = row[2]
            sums[row[0], int(row[1])] = row[3:]
        return n, sums
