"""Counts and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.functions import bits, stats


def with_discs(df: DataFrame) -> DataFrame:
    return df.withColumn("discs", bits.popcount(F.col("player"), F.col("opponent")))


def count_by_discs(df: DataFrame) -> DataFrame:
    return with_discs(df).groupBy("discs").agg(F.count("*").alias("boards"))


def average_discs(df: DataFrame) -> DataFrame:
    return with_discs(df).agg(F.round(F.avg("discs"), 6).alias("avg_discs"), F.count("*").alias("boards"))


def pivot_discs(df: DataFrame, name: str, names: list) -> DataFrame:
    """Boards by discs, a column for each name; 0 where there are none."""
    return with_discs(df).groupBy("discs").pivot(name, names).agg(F.count(F.lit(1))).fillna(0)


def totals(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("boards"))


def count_distinct(df: DataFrame) -> DataFrame:
    return df.select("player", "opponent").distinct().agg(F.count("*").alias("boards"))


def wilson_ci(verdicts: DataFrame, alpha: float = 0.005) -> DataFrame:
    """Counts of OK, NG and UNKNOWN, the interval of the share of OK (its upper bound counts UNKNOWN as OK), and the
    interval scaled to all positions.  No verdicts at all, or an alpha out of (0, 1), is an error."""
    number = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    return _interval(verdicts.agg(number("OK").alias("ok"), number("NG").alias("ng"), number("UNKNOWN").alias("unknown")), alpha)


def interval(spark: SparkSession, counts: list[tuple[str, int]], alpha: float = 0.005) -> DataFrame:
    """The same of counts that are known: (verdict, number)."""
    known = dict(counts)
    return _interval(spark.createDataFrame([tuple(known.get(v, 0) for v in ("OK", "NG", "UNKNOWN"))], "ok long, ng long, unknown long"), alpha)


def _interval(counts: DataFrame, alpha: float) -> DataFrame:
    z = stats.norm_ppf(alpha)
    n = (F.col("ok") + F.col("ng") + F.col("unknown")).cast("double")
    n = F.when(n > 0, n).otherwise(F.raise_error(F.lit("no verdicts")).cast("double"))
    low = stats.wilson_bounds(F.col("ok").cast("double"), n, z)["lower"]
    high = stats.wilson_bounds((F.col("ok") + F.col("unknown")).cast("double"), n, z)["upper"]
    out = counts.withColumn("lower", low).withColumn("upper", high)
    return out.withColumn("population_lower", stats.scale_to_population(F.col("lower"))).withColumn("population_upper", stats.scale_to_population(F.col("upper")))
