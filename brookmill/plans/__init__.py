"""Registered queries: each binds operators to the provided tables and carries the
ANSI SQL that states the same question."""

from __future__ import annotations

from . import (  # noqa: F401
    generator_queries,
    graph_queries,
    learning_queries,
    mileage_queries,
    pageview_queries,
    record_queries,
    telemetry_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
