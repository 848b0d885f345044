"""The kernels as Pandas UDFs over board columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardsift.functions import kernels


def _masks(*columns: pd.Series) -> list[np.ndarray]:
    return [c.to_numpy(np.int64).view(np.uint64) for c in columns]


@F.pandas_udf(T.BooleanType())
def seg3_more(player: pd.Series, opponent: pd.Series) -> pd.Series:
    """Segments of three with the capabilities of their discs; meant for boards that pass the occupancy filter."""
    return pd.Series(kernels.seg3_more(*_masks(player, opponent)))


@F.pandas_udf(T.BooleanType())
def seg3(occupied: pd.Series) -> pd.Series:
    return pd.Series(kernels.seg3(*_masks(occupied)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def occupancy_order(occupied: pd.Series) -> pd.Series:
    """For each square what is explained without it, and itself; 0 for an empty square."""
    return pd.Series(list(kernels.order_masks(*_masks(occupied)).view(np.int64)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def line_runs(occupied: pd.Series) -> pd.Series:
    """Length of the occupied run from each occupied square in each direction, itself included (at square * 8 + d)."""
    there = kernels.cells(*_masks(occupied))
    runs = (kernels.run_lengths(there) + 1) * there[:, :64, None]
    return pd.Series(list(runs.reshape(len(runs), -1).astype(np.int32)))


@F.pandas_udf(T.LongType())
def stable_discs(occupied: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series(kernels.stable(*_masks(occupied, target)).view(np.int64))
