"""The nearest of many centres, by block matrix products behind triangle bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .learning import _matrix

CENTRES_PER_BLOCK = 128
ROWS_AT_ONCE = 4096


class CentreBlocks:
    """Centres in blocks of neighbours, each with a middle and a radius.

    A point that is further from a block's middle than the radius and its best distance so
    far together cannot have its nearest centre in there, so most blocks are passed over.
    In the others all squared distances come from one matrix product and the norms; those
    within its rounding of the smallest are worked out exactly, so result and ties (the
    lowest index wins) are those of comparing every centre.
    """

    def __init__(self, centres: np.ndarray, per_block: int = CENTRES_PER_BLOCK):
        k = len(centres)
        if not k:
            raise ValueError("no centre to be near to")
        pivots = centres[np.linspace(0, k - 1, -(-k // per_block)).astype(int)]
        home = _products(centres, pivots).argmin(axis=1)
        self.blocks = []
        for b in np.unique(home):
            index = np.flatnonzero(home == b)
            mine = centres[index]
            middle = mine.mean(axis=0)
            radius = np.sqrt(((mine - middle) ** 2).sum(axis=1).max())
            self.blocks.append((index, mine, (mine * mine).sum(axis=1), radius))
        self.middles = np.array([mine.mean(axis=0) for _, mine, _, _ in self.blocks])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest centre of each row."""
        best, dist = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        for at in range(0, len(x), ROWS_AT_ONCE):
            part = slice(at, at + ROWS_AT_ONCE)
            best[part], dist[part] = self._nearest(x[part])
        return best, dist

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = (x * x).sum(axis=1)
        reach = np.sqrt(np.maximum(_products(x, self.middles), 0))
        best, dist = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.inf)
        # the blocks that most rows lie nearest to come first, so that bounds are tight early
        for b in np.argsort(-np.bincount(reach.argmin(axis=1), minlength=len(self.blocks)), kind="stable"):
            index, mine, own, radius = self.blocks[b]
            slack = 1e-7 * (1 + reach[:, b] + radius)
            rows = np.flatnonzero(reach[:, b] - radius <= np.sqrt(dist) + slack)
            if not len(rows):
                continue
            rough = norms[rows, None] - 2 * (x[rows] @ mine.T) + own
            margin = 1e-11 * (norms[rows] + own.max() + 1)
            limit = np.minimum(rough.min(axis=1), dist[rows]) + margin
            r, c = np.nonzero(rough <= limit[:, None])
            exact = ((x[rows[r]] - mine[c]) ** 2).sum(axis=1)
            order = np.lexsort((index[c], exact, r))
            first = order[np.r_[True, r[order][1:] != r[order][:-1]]] if len(order) else order
            row, d, i = rows[r[first]], exact[first], index[c[first]]
            better = (d < dist[row]) | ((d == dist[row]) & (i < best[row]))
            best[row[better]], dist[row[better]] = i[better], d[better]
        return best, dist


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, as the matrix product gives them."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)


def assign_nearest(points: DataFrame, features: str, centres: np.ndarray, per_block: int = CENTRES_PER_BLOCK) -> DataFrame:
    """Add ``cluster`` and ``dist`` (squared) of the nearest of many centres to each point.

    The centres are one array in every task (8 bytes per number); points are read once
    and not moved.
    """
    blocks = points.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=float))
    names, at = points.columns, points.columns.index(features)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

    def run(batches):
        index = CentreBlocks(blocks.value, per_block)
        for batch in batches:
            matrix = _matrix(batch.column(at))
            best, dist = index.nearest(matrix) if len(matrix) else (np.empty(0), np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(dist)], [*names, "cluster", "dist"])

    return points.mapInArrow(run, schema + ", cluster int, dist double")
