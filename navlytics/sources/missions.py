"""Named data sources: a mission maps table names to loaders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Loader = Callable[[SparkSession, str], DataFrame]
_MISSIONS: dict[str, "Mission"] = {}


@dataclass(frozen=True)
class Mission:
    """Loaders of one kind of recording; each gets the session and the data path."""

    name: str
    loaders: dict[str, Loader] = field(default_factory=dict)

    def load(self, spark: SparkSession, path: str) -> dict[str, DataFrame]:
        return {k: f(spark, path) for k, f in self.loaders.items()}


def register(mission: Mission) -> Mission:
    _MISSIONS[mission.name] = mission
    return mission


def get(name: str) -> Mission:
    if name not in _MISSIONS:
        raise KeyError(f"unknown mission {name!r}; known: {sorted(_MISSIONS)}")
    return _MISSIONS[name]
