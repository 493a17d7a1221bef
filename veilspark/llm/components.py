"""Connected components of a link table: a small one in one task, any other by steps over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components as steps

__all__ = ["components"]

#: Links that one task takes at most, two longs each, so 2 MB whatever the input.
LOCAL_LINKS = 1 << 17


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link to another one. ``links`` should be a written
    table, since it is counted first: at most LOCAL_LINKS links between longs are merged by one task, which spares the many
    steps' fixed costs; all others go by the steps of ``operators.components``. Both are exact and give the same rows."""
    own = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    if {kind for _, kind in own.dtypes} != {"bigint"} or own.count() > LOCAL_LINKS:
        return steps.components(links, left, right)
    return own.coalesce(1).mapInArrow(_merged, "node long, component long")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all links; a root is the least node of its set."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate([x for pair in zip(*ends) for x in pair]), return_inverse=True)
    root = list(range(len(nodes)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in at.reshape(2, -1).T.tolist():
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    least = nodes[[top(x) for x in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])
