"""Brookmill: batch, graph, learning, streaming and telemetry jobs as PySpark plans."""
