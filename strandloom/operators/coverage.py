"""Coverage as run-length rows: sweep line, merging of runs, thresholds, junctions, node statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .intervals import TILE, overlap_join

#: Sums that differ by less than this share differ by rounding alone.
ROUNDING = 1e-9


def runs(intervals: DataFrame, keys: list[str], value: str = "expr", tile: int = TILE) -> DataFrame:
    """Sum of ``value`` over every position, as maximal runs of equal, non-zero sums.

    Which positions are covered is decided by a count of the intervals of non-zero value, so sums of
    fractions, which need not cancel to zero, make no runs of their own; steps and sums that differ by
    rounding alone are equal.

    Intervals are cut at tile borders, so a window never holds more than one tile; only runs at
    tile borders meet in a window over a whole sequence, to be joined again.
    """
    whole = intervals.where((F.col("end") > F.col("start")) & (F.col(value) != 0))
    spread = whole.withColumn("_tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))))
    a = F.greatest(F.col("start").cast("long"), F.col("_tile") * tile)
    b = F.least(F.col("end").cast("long"), (F.col("_tile") + 1) * tile)
    v = F.col(value).cast("double")
    ends = F.array(F.struct(a.alias("pos"), v.alias("d"), F.lit(1).alias("n")), F.struct(b.alias("pos"), (-v).alias("d"), F.lit(-1).alias("n")))
    edges = spread.select(*keys, "_tile", F.explode(ends).alias("e"))
    steps = edges.groupBy(*keys, "_tile", F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"), F.sum("e.n").alias("n"), F.sum(F.abs("e.d")).alias("size"))
    w = Window.partitionBy(*keys, "_tile").orderBy("pos")
    level = steps.select("*", F.sum("d").over(w).alias("value"), F.sum("n").over(w).alias("upon"))
    crossing = (F.col("upon") == 0) != (F.col("upon") == F.col("n"))
    level = level.where((F.abs("d") > F.col("size") * ROUNDING) | crossing)
    level = level.select(*keys, "_tile", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), "value", "upon")
    level = level.where("`end` IS NOT NULL AND upon <> 0 AND value <> 0").drop("upon")
    inner = (F.col("start") > F.col("_tile") * tile) & (F.col("end") < (F.col("_tile") + 1) * tile)
    border = level.where(~inner)
    order = Window.partitionBy(*keys).orderBy("start")
    last, was = F.lag("end").over(order), F.lag("value").over(order)
    fresh = last.isNull() | (last != F.col("start")) | (F.abs(was - F.col("value")) > ROUNDING * F.greatest(F.abs(was), F.abs("value")))
    border = border.withColumn("_new", F.when(fresh, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(order))
    border = border.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value")).drop("_run")
    return level.where(inner).drop("_tile").unionByName(border)


def with_zeros(level: DataFrame, keys: list[str]) -> DataFrame:
    """Runs plus zero runs between neighbours that do not touch."""
    w = Window.partitionBy(*keys).orderBy("start")
    gaps = level.select(*keys, F.col("end").alias("start"), F.lead("start").over(w).alias("end"), F.lit(0.0).alias("value")).where("start < `end`")
    return level.unionByName(gaps)


def threshold_points(level: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """Positions at which the value crosses the threshold between two neighbouring positions."""
    w = Window.partitionBy(*keys).orderBy("start")
    high = F.col("value") > threshold
    before = F.lag("value").over(w) > threshold
    return with_zeros(level, keys).withColumn("_cross", before != high).where("_cross").select(*keys, F.col("start").alias("pos"))


def introns(exons: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between a transcript's neighbouring exons: start, end and the carried columns."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return exons.withColumn("_next", F.lead("start").over(w)).where("_next IS NOT NULL").withColumn("start", F.col("end")).withColumn("end", F.col("_next")).drop("_next")


def junctions(exons: DataFrame, keys: list[str]) -> DataFrame:
    """Summed expression of equal stranded introns, as BED12 fields of a junction track.

    Rows marked ``is_ref``, if there is such a column, take no part.
    """
    if "is_ref" in exons.columns:
        exons = exons.where("NOT is_ref")
    found = introns(exons, keys).where("strand <> '.'").groupBy("seqid", "start", "end", "strand").agg(F.sum("expr").alias("expr"))
    return found.select(
        "seqid",
        (F.col("start") - 1).cast("long").alias("bed_start"),
        (F.col("end") + 1).cast("long").alias("bed_end"),
        "strand",
        F.col("expr").cast("double").alias("expr"),
        F.concat(F.lit("0,"), (F.col("end") - F.col("start") + 1).cast("string")).alias("block_starts"),
    )


def junction_line() -> Column:
    """The BED12 line of a row of ``junctions``."""
    s = lambda c: F.col(c).cast("string")
    return F.concat_ws("\t", s("seqid"), s("bed_start"), s("bed_end"), F.lit("JUNC"), s("expr"), "strand", s("bed_start"), s("bed_end"), F.lit("255,0,0"), F.lit("2"), F.lit("1,1"), "block_starts")


def dense(level: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every covered position of runs; overlapping runs add up."""
    return level.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "value").groupBy(*keys, "pos").agg(F.sum("value").alias("value"))


def node_statistics(nodes: DataFrame, level: DataFrame) -> DataFrame:
    """Least, largest and mean coverage of every node (uncovered positions count as zero)."""
    parts = overlap_join(nodes, level)
    size = F.least("end", "r_end") - F.greatest("start", "r_start")
    return parts.groupBy("seqid", "start", "end").agg(
        F.when(F.sum(size) < F.col("end") - F.col("start"), F.lit(0.0)).otherwise(F.min("r_value")).alias("low"),
        F.max("r_value").alias("high"),
        (F.sum(size * F.col("r_value")) / (F.col("end") - F.col("start"))).alias("mean"),
    )
