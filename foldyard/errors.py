"""Error classes; each carries the label stored in ``failed.error_type``."""

from __future__ import annotations

# Labels users filter on in the failed table.
CONFIG_DATA = "config_data"
INCOMPATIBLE_COMBO = "incompatible_combo"
MODEL_EXECUTION = "model_execution"
INTERNAL = "internal"


class ConfigDataError(ValueError):
    """Bad configuration or data; raised before any model is fitted."""

    error_type = CONFIG_DATA


class ModelExecutionError(RuntimeError):
    """One combination could not be fitted or scored; the run goes on."""

    error_type = MODEL_EXECUTION


def error_label(exc: BaseException) -> str:
    return getattr(exc, "error_type", INTERNAL)
