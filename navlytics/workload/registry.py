"""Imports every workload module so that the registries are full."""

from navlytics.workload import geometry, imagery, mapping, matching, misc, refinement, statistics, streams, telemetry  # noqa: F401
from navlytics.workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
