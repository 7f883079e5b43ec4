"""Forests whose trees are dealt over tasks; a task has a fold's rows, so there is a limit to these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import forest as T

#: Rows times features of a task that grows trees, at most.
CELLS = 1 << 23


def fits(rows: int, features: int) -> bool:
    """Whether tasks can grow trees over so many rows, those to be judged too."""
    return rows <= T.ROWS and rows * features <= CELLS


def _matrix(t: pa.Table, n: int) -> np.ndarray:
    column = t["features"].combine_chunks()
    values = column.flatten()
    if len(column) and (column.null_count or values.null_count or pc.any(pc.not_equal(pc.list_value_length(column), n)).as_py()):
        raise ValueError(f"a row has no {n} features, or one that is null")
    return values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), n)


class RandomForestClassifier:
    """Trees with exact splits and sqrt(features) tries a node, over rows drawn with repeats; parameters are called as Spark's are.

    A tree's draws follow from the seed and its number, counted from `first`, so a forest can be fitted in parts.  minInstancesPerNode and
    minInstancesPerSplit count different rows.
    """

    def __init__(self, *, numTrees: int, maxDepth: int, minInstancesPerNode: int = 1, minInstancesPerSplit: int = 2, seed: int = 42, first: int = 0):
        self.trees, self.rules, self.seed = range(first, first + numTrees), (maxDepth, minInstancesPerSplit, minInstancesPerNode), seed

    def getNumTrees(self) -> int:
        return len(self.trees)

    def fit(self, rows: DataFrame) -> DataFrame:
        """rows, in one partition: keys, y, weight (one for each class; null: to be judged), features (array).

        One task gives (keys, y, place, feature, value): sums over its trees of a judged row's score, where feature is null, and of a feature's
        importance.  place is the row's, in order of keys, as keys may repeat.
        """
        keys = [c for c in rows.columns if c not in ("weight", "features")]
        trees, seed, rules = self.trees, self.seed, self.rules

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches)
            # In order, as a tree's draws are places.
            t = t.sort_by([(c, "ascending") for c in keys])
            train, test = t.filter(pc.is_valid(t["weight"])), t.filter(pc.is_null(t["weight"]))
            n = len(train["features"][0])
            y, weight = train["y"].to_numpy().astype(int), train["weight"].to_numpy()
            score, gain = T.judged(_matrix(train, n), y, np.array([weight[y == k][0] for k in (0, 1)]), _matrix(test, n), trees, seed, *rules)
            at = {c: test[c] for c in keys} | {"place": np.arange(len(test)), "feature": pa.nulls(len(test), pa.int64()), "value": score}
            own = {c: pa.nulls(n, t.schema.field(c).type) for c in keys} | {"place": pa.nulls(n, pa.int64()), "feature": np.arange(n), "value": gain}
            for some in (at, own):
                yield from pa.table(some).to_batches()

        kinds = dict(rows.dtypes)
        return rows.mapInArrow(part, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", place long, feature long, value double")
