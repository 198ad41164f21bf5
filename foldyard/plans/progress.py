"""Finished experiments of a run, so that a stopped run can continue.

One table serves many runs: run, experiment (its techniques and parameters), kind
(``detailed`` or ``failed``) and row, the result row as text. Each few experiments append
their rows in one write, so an experiment is there whole or not at all.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .experiments import Experiment

BATCH = 16
SCHEMA = "run string, experiment string, kind string, row string"


def _digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Progress:
    """``folder``: the table. ``source``: what tells the run's input apart."""

    spark: SparkSession
    folder: str
    source: Any
    run: str = ""

    def named(self, facts: list) -> "Progress":
        return replace(self, run=_digest([self.source, facts]))

    @staticmethod
    def key(experiment: Experiment) -> str:
        """The same for the same techniques and parameters, whatever the search around."""
        return _digest(experiment.row()[1:])

    def table(self) -> DataFrame:
        """Rows of this run; none where the folder does not exist yet."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.folder).where(F.col("run") == self.run)

    def complete(self, engine: Engine, experiments: list[Experiment]) -> tuple[list[tuple], list[tuple]]:
        """(detailed rows, failed rows) of all experiments, run or read back."""
        keys = self.spark.createDataFrame([(self.key(e), i) for i, e in enumerate(experiments)], "experiment string, i int")
        left = keys.join(self.table(), "experiment", "left_anti").collect()
        todo = [experiments[i] for i in sorted(r["i"] for r in left)]
        for start in range(0, len(todo), BATCH):
            batch = todo[start : start + BATCH]
            names = {e.experiment_id: self.key(e) for e in batch}
            rows = [
                (self.run, names[row[0]], kind, json.dumps(list(row[1:])))
                for kind, found in zip(("detailed", "failed"), engine.run(batch))
                for row in found
            ]
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        ids = {self.key(e): e.experiment_id for e in experiments}
        found: dict[str, dict[tuple, None]] = {"detailed": {}, "failed": {}}
        for r in self.table().collect():  # experiments x folds rows
            if r["experiment"] in ids:
                found[r["kind"]][(ids[r["experiment"]], *json.loads(r["row"]))] = None
        return sorted(found["detailed"], key=lambda row: row[:1]), sorted(found["failed"], key=lambda row: row[:1])
