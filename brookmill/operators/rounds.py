"""Loops: one place that decides when a round's state is materialised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import cut_lineage


def iterate(
    state: DataFrame,
    step: Callable[[DataFrame, int], DataFrame],
    rounds: int,
    cut_every: int = 3,
) -> DataFrame:
    """Apply ``step(state, round)`` a fixed number of times.

    Between cuts the rounds stay one lazy plan; every ``cut_every`` rounds the state
    is written to shared storage, which bounds plan size and replay after a loss.
    """
    for i in range(rounds):
        state = step(state, i)
        if cut_every and (i + 1) % cut_every == 0 and i + 1 < rounds:
            state = cut_lineage(state)
    return state
