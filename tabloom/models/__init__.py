"""The fixed model zoo: one configuration per model, no search."""

from tabloom.models.base import Fold, ModelSpec
from tabloom.models.classification import CLASSIFICATION
from tabloom.models.clustering import CLUSTERING
from tabloom.models.regression import REGRESSION

__all__ = ["Fold", "ModelSpec", "select_zoo"]


def select_zoo(task: str) -> list[ModelSpec]:
    """The models of a task."""
    zoo = {"classification": CLASSIFICATION, "regression": REGRESSION, "clustering": CLUSTERING}
    if task not in zoo:
        raise ValueError(f"unknown task {task!r}: use one of {sorted(zoo)}")
    return list(zoo[task])
