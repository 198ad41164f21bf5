"""Distributed cross-validation and model comparison on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .errors import ConfigDataError, ModelExecutionError  # noqa: E402
from .plans.api import Prepared, benchmark, plan, prepare  # noqa: E402
from .plans.registry import register  # noqa: E402
from .plans.report import Results  # noqa: E402

__all__ = [
    "ConfigDataError",
    "ModelExecutionError",
    "Prepared",
    "Results",
    "benchmark",
    "plan",
    "prepare",
    "register",
]
