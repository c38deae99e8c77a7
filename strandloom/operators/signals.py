"""One-dimensional signals: smoothing, gradients, split points, slopes, cumulative sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F


def window_weights(kind: str, length: int) -> list[float]:
    """Normalised weights of the named smoothing window."""
    n = length - 1
    shapes = {
        "flat": lambda k: 1.0,
        "hanning": lambda k: 0.5 - 0.5 * math.cos(2 * math.pi * k / n),
        "hamming": lambda k: 0.54 - 0.46 * math.cos(2 * math.pi * k / n),
        "bartlett": lambda k: 1.0 - abs(2.0 * k / n - 1.0),
        "blackman": lambda k: 0.42 - 0.5 * math.cos(2 * math.pi * k / n) + 0.08 * math.cos(4 * math.pi * k / n),
    }
    raw = [shapes[kind](k) for k in range(length)]
    return [w / sum(raw) for w in raw]


def smooth(signal: DataFrame, keys: list[str], kind: str = "hanning", length: int = 11) -> DataFrame:
    """Weighted mean of a centred window (rows key, pos, value), for signals of ``length`` or more.

    Outside the signal the values are its mirror image, without repeating the end point.
    """
    half = length // 2
    k, n = F.col("_k"), F.col("_n")
    df = signal.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)
    df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(n >= length)
    head = df.where((k >= 1) & (k <= half)).withColumn("_k", -k)
    tail = df.where((k >= n - 1 - half) & (k <= n - 2)).withColumn("_k", 2 * (n - 1) - k)
    w = Window.partitionBy(*keys).orderBy("_k")
    total = F.lit(0.0)
    for weight, shift in zip(window_weights(kind, length), range(-half, half + 1)):
        total = total + F.lit(weight) * F.lead("value", shift).over(w)
    return df.unionByName(head).unionByName(tail).withColumn("smoothed", total).where((k >= 0) & (k < n)).drop("_k", "_n")


def gradient(signal: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy("pos")
    after, before = F.lead(value).over(w), F.lag(value).over(w)
    slope = F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2.0)
    return signal.withColumn("gradient", slope)


def mse_split(signal: DataFrame, keys: list[str]) -> DataFrame:
    """The split (at a change of value) with the least squared error inside both parts.

    Prefix sums give every split's error at once; the first of equal errors wins, and a signal
    without a change has split -1.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    v = F.col("value")
    df = signal.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(every))
    df = df.withColumn("_s", F.sum("value").over(before)).withColumn("_q", F.sum(v * v).over(before))
    df = df.withColumn("_ts", F.sum("value").over(every)).withColumn("_tq", F.sum(v * v).over(every)).withColumn("_was", F.lag("value").over(w))
    left = F.col("_q") - F.col("_s") * F.col("_s") / F.col("_i")
    right = (F.col("_tq") - F.col("_q")) - (F.col("_ts") - F.col("_s")) * (F.col("_ts") - F.col("_s")) / (F.col("_n") - F.col("_i"))
    df = df.withColumn("_sse", F.when((F.col("_i") > 0) & (F.col("_was") != v), F.round(left + right, 6)))
    best = F.min(F.when(F.col("_sse").isNotNull(), F.struct("_sse", "_i")))
    return df.groupBy(*keys).agg(F.coalesce(best["_i"], F.lit(-1)).cast("int").alias("split"))


def slope_runs(signal: DataFrame, keys: list[str]) -> DataFrame:
    """For every position, how many neighbours on either side (itself included) slope alike."""
    w = Window.partitionBy(*keys).orderBy("pos")
    df = gradient(signal, keys).withColumn("sign", F.signum("gradient"))
    df = df.withColumn("_new", F.when(F.lag("sign").over(w).eqNullSafe(F.col("sign")), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    run = Window.partitionBy(*keys, "_run").orderBy("pos")
    left = F.row_number().over(run)
    right = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")) - left + 1
    flat = F.col("sign") == 0
    return df.select(*keys, "pos", "sign", F.when(flat, 0).otherwise(left).cast("int").alias("dist_left"), F.when(flat, 0).otherwise(right).cast("int").alias("dist_right"))


def cusum(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Running sum of deviations from the mean: its range and the place of its largest size."""
    w = Window.partitionBy(*keys).orderBy("pos")
    df = signal.withColumn("_m", F.avg("value").over(Window.partitionBy(*keys)))
    df = df.withColumn("_s", F.round(F.sum(F.col("value") - F.col("_m")).over(w), 4))
    return df.groupBy(*keys).agg(F.round(F.max("_s") - F.min("_s"), 2).alias("range"), F.min("pos").alias("first_pos"), F.max_by("pos", F.struct(F.abs("_s"), -F.col("pos"))).alias("peak_pos"))
