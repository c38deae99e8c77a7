"""Ranks, percentiles, tie correction and the Mann-Whitney test as windows and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The five ranking methods of ``value`` in its group (ordinal ties follow all columns).

    Windows run over distinct values and their counts; rows meet their value's ranks in a join, and
    only rows of one value are numbered together.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    below = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(*[F.col(c).alias(f"_{c}") for c in (*keys, value)], "_n", below.alias("_below"), F.row_number().over(w).alias("rank_dense"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, value)]
    at = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*[c for c in df.columns if c not in (*keys, value)] or [F.lit(0)]))
    return (
        df.withColumn("_at", at)
        .join(placed, same)
        .select(
            *df.columns,
            (F.col("_below") + 1).cast("int").alias("rank_min"),
            "rank_dense",
            (F.col("_below") + F.col("_at")).cast("int").alias("rank_ordinal"),
            (F.col("_below") + F.col("_n")).cast("int").alias("rank_max"),
            (F.col("_below") + (F.col("_n") + 1) / 2.0).alias("rank_average"),
        )
    )


def percentile(df: DataFrame, keys: list[str], value: str, per: float, limit: tuple[float, float] | None = None) -> DataFrame:
    """Score at a percentile by fraction, lower and higher interpolation, inside closed limits.

    A window over distinct values and their counts finds the values at both neighbouring places.
    """
    if limit is not None:
        df = df.where(F.col(value).between(*limit))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(value))
    spot = F.lit(per / 100.0) * (F.sum("_n").over(Window.partitionBy(*keys)) - 1)
    ranked = counts.withColumn("_upto", upto).withColumn("_spot", spot)
    found = ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("_upto") > F.floor("_spot"), F.col(value))).alias("lower"),
        F.min(F.when(F.col("_upto") > F.ceil("_spot"), F.col(value))).alias("higher"),
        (F.first("_spot") - F.floor(F.first("_spot"))).alias("_part"),
    )
    return found.select(*keys, (F.col("lower") + (F.col("higher") - F.col("lower")) * F.col("_part")).alias("fraction"), "lower", "higher")


def tie_correction(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1 - sum(c**3 - c) / (n**3 - n) over the sizes of groups of equal values (1 if n < 2)."""
    sizes = df.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("c"))
    n = F.sum("c")
    return sizes.groupBy(*keys).agg(F.when(n < 2, F.lit(1.0)).otherwise(1.0 - F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")) / (n * n * n - n)).alias("correction"))


def normal_sf(z: Column) -> Column:
    """Survival function of the standard normal, as expressions: Spark has no error function.

    For |z| below 3 the integral's power series, beyond it a continued fraction; both to about
    1e-15 of the value.
    """
    x = F.abs(z)
    density = F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
    # Sum of x^(2k+1) / (1 * 3 * ... * (2k+1)), from the last term inwards.
    series = F.lit(1.0)
    for k in range(60, 0, -1):
        series = 1.0 + x * x / float(2 * k + 1) * series
    tail = x
    for k in range(60, 0, -1):
        tail = x + float(k) / tail
    upper = F.when(x < 3.0, 0.5 - density * x * series).otherwise(density / tail)
    return F.when(z < 0, 1.0 - upper).otherwise(upper)


def mann_whitney(df: DataFrame, keys: list[str], side: str, value: str, alternative: str = "two-sided", continuity: bool = True) -> DataFrame:
    """U of the second sample, z with tie correction, and its p; ``side`` is 'x' or 'y'.

    ``alternative`` is less, greater or two-sided.  Without a spread (all values equal, or a sample
    empty) z and p are null.

    Values of both samples are ranked together from counts of equal values, so the sort is over
    distinct values only.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.when(F.col(side) == "x", 1)).alias("cx"), F.count(F.when(F.col(side) == "y", 1)).alias("cy"))
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("cx") + F.col("cy")
    counts = counts.withColumn("rank", F.coalesce(F.sum(c).over(below), F.lit(0)) + (c + 1) / 2.0).withColumn("c", c.cast("double"))
    sums = counts.groupBy(*keys).agg(
        F.sum("cx").cast("double").alias("n1"),
        F.sum("cy").cast("double").alias("n2"),
        F.sum(F.col("cx") * F.col("rank")).alias("r1"),
        F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"),
    )
    n = F.col("n1") + F.col("n2")
    u1 = F.col("n1") * F.col("n2") + F.col("n1") * (F.col("n1") + 1) / 2.0 - F.col("r1")
    u2 = F.col("n1") * F.col("n2") - u1
    spread = F.sqrt((1.0 - F.col("ties") / (n * n * n - n)) * F.col("n1") * F.col("n2") * (n + 1) / 12.0)
    mean = F.col("n1") * F.col("n2") / 2.0 + (0.5 if continuity else 0.0)
    over = {"less": u1 - mean, "greater": u2 - mean, "two-sided": F.abs(F.greatest(u1, u2) - mean)}[alternative]
    scored = sums.select(*keys, u2.alias("u2"), F.when(spread > 0, over / spread).alias("z"))
    return scored.withColumn("p", normal_sf(F.col("z")) * (2.0 if alternative == "two-sided" else 1.0))
