"""Scans and sinks: telemetry, labels, meshes, rasters and reconstruction datasets as tables."""
