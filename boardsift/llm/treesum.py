"""Sums of fixed-size count arrays over all partitions, a few partials at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from boardsift.llm.common import staged

#: Partial arrays added in one task at once.
FAN = 32
_ROWS = "part long, block long, data binary"


def partial_rows(total: np.ndarray, blocks: int) -> pa.RecordBatch:
    """One partition's array, cut into blocks."""
    part = TaskContext.get().partitionId()
    pieces = np.split(total, blocks)
    return pa.RecordBatch.from_arrays([pa.array(np.full(blocks, part)), pa.array(np.arange(blocks)), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["part", "block", "data"])


def _add(dtype: str):
    def work(key, table):
        total = None
        for data in table.column("data"):
            piece = np.frombuffer(data.as_buffer(), dtype)
            total = piece.copy() if total is None else total + piece
        return pa.table({"part": [key[0].as_py()], "block": [key[1].as_py()], "data": pa.array([total.tobytes()], pa.binary())})

    return work


def tree_sum(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], size: int, blocks: int, dtype: str, tag: str) -> np.ndarray:
    """The sum of the arrays that ``make`` yields (by :func:`partial_rows`) for the partitions of ``rows``.

    ``size`` is fixed, so what reaches the driver is as large for any input.
    """
    parts = max(1, rows.rdd.getNumPartitions())
    partial = rows.mapInArrow(make, _ROWS)
    while True:
        partial = partial.selectExpr(f"part div {FAN} AS part", "block", "data").groupBy("part", "block").applyInArrow(_add(dtype), _ROWS)
        parts = -(-parts // FAN)
        if parts == 1:
            break
    partial = staged(partial, tag)
    total = np.zeros(size, dtype)
    step = size // blocks
    for row in partial.toLocalIterator():
        total[row["block"] * step : (row["block"] + 1) * step] += np.frombuffer(row["data"], dtype)
    return total
