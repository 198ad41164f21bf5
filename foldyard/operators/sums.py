"""Additive statistics of a design table, per fold model, in one pass.

A design table has ``fold`` int, ``y`` double and ``x`` array<double>. Iterative
estimators need, for every fold model, a sum over its training rows of some function
of (X, y). ``fold_sums`` evaluates it on Arrow batches inside the tasks, adds the
partial vectors up with ``Summarizer`` in two levels, and returns one vector per model.
One pass serves the models of all folds. Estimators that make many passes read
``in_blocks`` of the table instead.
"""

from __future__ import annotations

import pickle
from typing import Any, Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUM_SHARDS = 64
BLOCK_ROWS = 4096  # of a narrow table: what a kernel makes of them stays in the core's cache
BLOCK_VALUES = 1 << 18


def _ship(design: DataFrame, params: Any):
    """Broadcast model-sized parameters, with the code of their classes."""
    return design.sparkSession.sparkContext.broadcast(cloudpickle.dumps(params))


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(X, y, fold) arrays of one design batch."""
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    y = batch.column("y").to_numpy(zero_copy_only=False)
    fold = batch.column("fold").to_numpy(zero_copy_only=False)
    return x, y, fold


def _block_rows(width: int) -> int:
    return min(BLOCK_ROWS, max(BLOCK_VALUES // (width + 1), 1))


def in_blocks(design: DataFrame) -> DataFrame:
    """The design table with many rows of one fold in each row, ``y`` and ``x`` as raw
    doubles: a pass converts no rows and picks none by fold. Folds that are null are -1,
    the fold of no model."""

    def block(fold, x, y):
        return pa.RecordBatch.from_arrays(
            [pa.array([fold], pa.int32()), pa.array([y.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
            names=["fold", "y", "x"],
        )

    def run(batches):
        held: dict[int, list] = {}  # fewer rows of each fold than a block has
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ys, folds = unpack(batch)
            size = _block_rows(xs.shape[1])
            for fold in np.unique(folds).tolist():
                own = folds == fold
                parts = [*held.get(fold, []), (xs[own], ys[own])]
                if sum(len(y) for _, y in parts) >= size:
                    x, y = (np.concatenate(p) for p in zip(*parts))
                    full = len(y) - len(y) % size
                    for s in range(0, full, size):
                        yield block(fold, x[s : s + size], y[s : s + size])
                    parts = [(x[full:], y[full:])] if full < len(y) else []
                held[fold] = parts
        for fold, parts in held.items():
            if parts:
                yield block(fold, *(np.concatenate(p) for p in zip(*parts)))

    rows = design.select(F.coalesce("fold", F.lit(-1)).alias("fold"), "y", "x")
    return rows.mapInArrow(run, "fold int, y binary, x binary")


def _pieces(batch: pa.RecordBatch):
    """(X, y, fold) of a batch of rows, or of each block in it with one fold."""
    if batch.num_rows and not isinstance(batch.column("x"), (pa.BinaryArray, pa.LargeBinaryArray)):
        yield unpack(batch)
        return
    for fold, y, x in zip(*(batch.column(c) for c in ("fold", "y", "x"))):
        targets = np.frombuffer(y.as_buffer(), np.float64)
        yield np.frombuffer(x.as_buffer(), np.float64).reshape(len(targets), -1), targets, np.array([fold.as_py()])


def _add_up(partials: DataFrame) -> dict[int, np.ndarray]:
    total = Summarizer.metrics("sum").summary(F.col("v")).getField("sum").alias("v")
    shard = F.pmod(F.spark_partition_id(), F.lit(SUM_SHARDS)).alias("shard")
    level = partials.select("model", shard, array_to_vector("v").alias("v"))
    level = level.groupBy("model", "shard").agg(total)
    rows = level.groupBy("model").agg(total).collect()
    return {r["model"]: r["v"].toArray() for r in rows}


def fold_sums(
    design: DataFrame,
    kernel: Callable[[np.ndarray, np.ndarray, Any], np.ndarray],
    params: list[Any],
    size: int,
    per_fold: bool = False,
) -> np.ndarray:
    """Sum of ``kernel(X, y, params[m])`` over the rows outside fold m, for each m.

    ``design`` may be in blocks. With ``per_fold`` the sum runs over the rows *of* fold m
    instead.
    """
    shared = _ship(design, params)
    models = len(params)

    def run(batches):
        local = pickle.loads(shared.value)
        sums = np.zeros((models, size))
        for x, y, fold in (piece for batch in batches for piece in _pieces(batch)):
            for m, param in enumerate(local):
                keep = (fold == m) if per_fold else (fold != m)
                if keep.all():
                    sums[m] += kernel(x, y, param)
                elif keep.any():
                    sums[m] += kernel(x[keep], y[keep], param)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(models), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))],
            names=["model", "v"],
        )

    found = _add_up(
        design.select("fold", "y", "x").mapInArrow(run, "model int, v array<double>")
    )
    shared.unpersist()
    return np.stack([found.get(m, np.zeros(size)) for m in range(models)])


def out_of_fold(
    design: DataFrame,
    function: Callable[[np.ndarray, Any], np.ndarray],
    params: list[Any],
) -> DataFrame:
    """(fold, y, z): ``z = function(X, params[fold])``, each row by its own fold's model."""
    shared = _ship(design, params)

    def run(batches):
        local = pickle.loads(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold = unpack(batch)
            z = None
            for m in np.unique(fold):
                rows = fold == m
                part = np.asarray(function(x[rows], local[m]), dtype=float)
                part = part.reshape(rows.sum(), -1)
                if z is None:
                    z = np.empty((len(y), part.shape[1]))
                z[rows] = part
            yield pa.RecordBatch.from_arrays(
                [batch.column("fold"), batch.column("y"), pa.array(list(z), pa.list_(pa.float64()))],
                names=["fold", "y", "z"],
            )

    return design.select("fold", "y", "x").mapInArrow(
        run, "fold int, y double, z array<double>"
    )


def apply_rows(
    design: DataFrame, function: Callable[[np.ndarray, Any], np.ndarray], param: Any
) -> DataFrame:
    """The design table with ``x`` replaced by ``function(X, param)``."""
    shared = _ship(design, param)

    def run(batches):
        local = pickle.loads(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _, _ = unpack(batch)
            z = np.asarray(function(x, local), dtype=float).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("fold"), batch.column("y"), pa.array(list(z), pa.list_(pa.float64()))],
                names=["fold", "y", "x"],
            )

    return design.select("fold", "y", "x").mapInArrow(
        run, "fold int, y double, x array<double>"
    )
