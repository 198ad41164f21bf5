"""The search space as an experiments relation, its validity and its size."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigDataError
from ..functions.params import grid_list
from .registry import COST, STEPS, UNKNOWN_COST, check_technique

COMBO_COLUMNS = [
    "experiment_id",
    *(name for step in STEPS for name in (step, f"{step}_params")),
]
COMBO_SCHEMA = "experiment_id int, " + ", ".join(f"{c} string" for c in COMBO_COLUMNS[1:])

# Reasons shown for combinations that cannot run.
NMF_AFTER_STD = "NMF skipped: standardization can create negative values"
NMF_NEGATIVE = "NMF skipped: input data contains negative values"


def section(config: dict[str, Any], name: str) -> dict[str, Any]:
    found = config.get(name)
    if not isinstance(found, dict):
        raise ConfigDataError(f"The configuration has no [{name}] section")
    return found


@dataclass(frozen=True)
class Variant:
    """One technique with concrete parameters."""

    key: str
    params: dict[str, Any]

    @property
    def rendered(self) -> str:
        return str(self.params)


@dataclass(frozen=True)
class Experiment:
    """One combination of four variants, numbered from 1, model fastest."""

    experiment_id: int
    scale: Variant
    filter: Variant
    reduction: Variant
    model: Variant

    def row(self) -> tuple:
        cells: list[Any] = [self.experiment_id]
        for step in STEPS:
            variant = getattr(self, step)
            cells += [variant.key, variant.rendered]
        return tuple(cells)

    def label(self, total: int) -> str:
        chain = "->".join(getattr(self, step).key for step in STEPS)
        return f"{chain} ({self.experiment_id}/{total})"

    def skip_reason(self, any_negative: bool) -> str | None:
        if self.reduction.key != "nmf":
            return None
        if self.scale.key == "std":
            return NMF_AFTER_STD
        return NMF_NEGATIVE if any_negative else None


def variants(task: str, search: dict[str, Any]) -> dict[str, list[Variant]]:
    """Variants of every step; the grid of a technique multiplies it."""
    found: dict[str, list[Variant]] = {}
    for step in STEPS:
        chosen = section(search, step)
        enabled = chosen.get("enabled", [] if step == "model" else ["none"])
        grids = chosen.get("params", {})
        found[step] = []
        for key in enabled:
            for params in grid_list(grids.get(key)):
                check_technique(task, step, key, params)
                found[step].append(Variant(key, params))
        if not found[step]:
            raise ConfigDataError(f"The search space enables no {step}")
    return found


def expand(task: str, config: dict[str, Any]) -> list[Experiment]:
    """All combinations of the configured search space; a configuration-sized list."""
    found = variants(task, section(config, "search"))
    combos = product(*(found[step] for step in STEPS))
    return [Experiment(i, *combo) for i, combo in enumerate(combos, start=1)]


def experiments_frame(spark: SparkSession, experiments: list[Experiment]) -> DataFrame:
    return spark.createDataFrame([e.row() for e in experiments], COMBO_SCHEMA)


def with_validity(experiments: DataFrame, any_negative: Column) -> DataFrame:
    """Add ``status`` (runnable / skipped) and ``reason``."""
    nmf = F.col("reduction") == "nmf"
    reason = F.when(nmf & (F.col("scale") == "std"), NMF_AFTER_STD).when(
        nmf & any_negative, NMF_NEGATIVE
    )
    return experiments.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "runnable").otherwise("skipped")
    )


def with_cost(experiments: DataFrame) -> DataFrame:
    """Add the relative cost: the product of four step weights."""
    cost = F.lit(1.0)
    for step in STEPS:
        weights = F.create_map(*[F.lit(v) for item in COST[step].items() for v in item])
        known = F.try_element_at(weights, F.col(step))
        cost = cost * F.coalesce(known, F.lit(UNKNOWN_COST[step]))
    return experiments.withColumn("relative_cost", cost)


def work_list(experiments: list[Experiment], folds: DataFrame) -> DataFrame:
    """Every experiment on every row of the fold table, with its label, without a join:
    the configuration-sized experiments travel as one array literal."""
    names = [*COMBO_COLUMNS, "label"]
    rows = [(*e.row(), e.label(len(experiments))) for e in experiments]
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return folds.select("*", F.inline(F.array(*structs)))


def plan_summary(experiments: DataFrame) -> DataFrame:
    """Counts and relative cost of a validated, costed experiments relation."""
    runnable = F.col("status") == "runnable"
    return experiments.agg(
        F.count("*").alias("combinations_total"),
        F.count_if(~runnable).alias("combinations_skipped"),
        F.count_if(runnable).alias("combinations_runnable"),
        F.coalesce(F.sum(F.when(runnable, F.col("relative_cost"))), F.lit(0.0)).alias(
            "relative_cost"
        ),
    )
