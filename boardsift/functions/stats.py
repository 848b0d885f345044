"""Intervals and counts, in native expressions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Positions of 60 squares of three states and four of two.
POPULATION = 3**60 * 2**4


def norm_ppf(alpha: float) -> float:
    """z of a two-sided interval at level 1 - alpha."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return NormalDist().inv_cdf(1 - alpha / 2)


def wilson_bounds(x: Column, n: Column, z: float) -> Column:
    """struct(lower, upper) of the Wilson score interval."""
    share = x / n
    z2 = F.lit(z * z)
    centre = share + z2 / (2.0 * n)
    radius = F.lit(z) * F.sqrt(share * (1.0 - share) / n + z2 / (4.0 * n * n))
    scale = 1.0 + z2 / n
    return F.struct(((centre - radius) / scale).alias("lower"), ((centre + radius) / scale).alias("upper"))


def scale_to_population(share: Column) -> Column:
    return share * F.lit(float(POPULATION))


def combination(n: Column, k: Column) -> Column:
    """n over k as DECIMAL(38,0); 0 for k > n, null beyond 38 digits."""
    step = lambda acc, i: F.call_function("try_divide", (acc * (n - i + F.lit(1))).cast("decimal(38,0)"), i.cast("decimal(10,0)")).cast("decimal(38,0)")
    product = F.aggregate(F.sequence(F.lit(1), F.least(k, n - k)), F.lit(1).cast("decimal(38,0)"), step)
    return F.when(k > n, F.lit(0).cast("decimal(38,0)")).when((k == 0) | (k == n), F.lit(1).cast("decimal(38,0)")).otherwise(product)
