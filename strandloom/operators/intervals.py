"""Half-open intervals: islands, clusters, overlap joins, nearest neighbours, numbering.

All functions take DataFrames with ``start`` and ``end`` and key columns (``seqid``, ...).
Running windows over a sequence are kept small: intervals are first merged inside tiles, so that
only islands, not intervals, meet in a sequence's window.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

TILE = 4096


def overlaps(a: str, b: str) -> Column:
    """Half-open overlap of ``a.start/a.end`` and ``b.start/b.end``; touching does not count."""
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def _islands(df: DataFrame, keys: list[str], gap: int, closed: bool, extra: list[Column]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(before) + gap
    fresh = F.col("start") > reach if closed else F.col("start") >= reach
    marked = df.withColumn("_new", F.when(reach.isNull() | fresh, 1).otherwise(0)).withColumn("_island", F.sum("_new").over(upto))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *extra).drop("_island")


def merge_islands(df: DataFrame, keys: list[str], gap: int = 0, closed: bool = False, sums: dict[str, Column] | None = None, tile: int = TILE) -> DataFrame:
    """Maximal runs of intervals that overlap (``closed``: touch, or lie within ``gap``).

    ``sums`` names sums over the members.  Merging is associative, so tiles are merged first.
    """
    sums = sums or {}
    parts = df.select(*keys, "start", "end", *(c.alias(n) for n, c in sums.items()), F.floor(F.col("start") / tile).alias("_tile"))
    total = [F.sum(n).alias(n) for n in sums]
    parts = _islands(parts, [*keys, "_tile"], gap, closed, total)
    return _islands(parts.drop("_tile"), keys, gap, closed, total)


def numbered(df: DataFrame, order: list[str], name: str, by: str = "seqid") -> DataFrame:
    """Global positions 1..n in the order (``by``, ``order``) without one global window.

    Ranks inside a sequence are shifted by the counts of the sequences before it, which take a
    window over one row a sequence.
    """
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("_rank", rank).join(offsets, by).withColumn(name, F.col("_rank") + F.col("_offset")).drop("_rank", "_offset")


def loci(features: DataFrame) -> DataFrame:
    """Locus index: locus_id (L1.. in sequence order), seqid, start, end, n_features."""
    found = merge_islands(features, ["seqid"], sums={"n_features": F.lit(1)})
    return numbered(found, ["start"], "_k").select(F.concat(F.lit("L"), "_k").alias("locus_id"), "seqid", "start", "end", F.col("n_features").cast("long").alias("n_features"))


def clusters(df: DataFrame, keys: list[str], max_dist: int, min_intervals: int) -> DataFrame:
    """Clusters of intervals no farther apart than ``max_dist``, of at least ``min_intervals``."""
    found = merge_islands(df, keys, gap=max_dist, closed=True, sums={"n": F.lit(1)})
    return found.where(F.col("n") >= min_intervals).select(*keys, "start", "end", F.col("n").cast("long").alias("n"))


def binned(df: DataFrame, size: int, name: str = "_bin") -> DataFrame:
    """A row for each bin an interval touches."""
    bins = F.sequence(F.floor(F.col("start") / size), F.floor((F.greatest("end", F.col("start") + 1) - 1) / size))
    return df.withColumn(name, F.explode(bins))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "seqid", size: int = TILE) -> DataFrame:
    """Pairs of overlapping intervals; right columns get the prefix ``r_``.

    Both sides are spread over bins, so the join has an equality on (key, bin); a pair is kept
    only in the later of its two first bins.
    """
    a = binned(left, size).alias("a")
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.col("start"), F.col("end"))
    b = binned(r, size).drop("start", "end").alias("b")
    first = F.greatest(F.floor(F.col("start") / size), F.floor(F.col("r_start") / size))
    hit = (F.col(key) == F.col(f"r_{key}")) & (F.col("a._bin") == F.col("b._bin")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    return a.join(b, hit & (F.col("a._bin") == first)).drop("_bin")


def nearest(queries: DataFrame, targets: DataFrame, side: str, n: int = 1, max_dist: int = 2500, key: str = "seqid", query: str = "q") -> DataFrame:
    """The ``n`` nearest targets before or after each query's ``pos``, less than ``max_dist`` away.

    Before: end <= pos - 1, distance pos - 1 - end.  After: start >= pos + 1, distance
    start - (pos + 1).  Distinct edges of a sequence are numbered (inside bins, shifted by the counts of
    the bins before); a query knows the number of the last edge within its limit, so its candidates are
    the edges of the ``n`` numbers up to it, and of each edge the first ``n`` targets: at most n * n a
    query, however many targets a place holds.
    """
    sign = 1 if side == "before" else -1
    edge = F.col("end") if side == "before" else -F.col("start")
    others = [c for c in targets.columns if c != key]
    t = targets.withColumn("_edge", edge.cast("long"))
    t = t.withColumn("_of", F.row_number().over(Window.partitionBy(key, "_edge").orderBy(*others))).where(F.col("_of") <= n).drop("_of")
    q = queries.withColumn("_limit", sign * F.col("pos").cast("long") - 1)
    edges = t.select(key, F.col("_edge").alias("_at"), F.lit(0).alias("_asks")).distinct()
    limits = q.select(key, F.col("_limit").alias("_at"), F.lit(1).alias("_asks")).distinct()
    places = edges.unionByName(limits).withColumn("_bin", F.floor(F.col("_at") / TILE))
    inside = F.sum(1 - F.col("_asks")).over(Window.partitionBy(key, "_bin").orderBy("_at", "_asks"))
    before = F.sum("_sum").over(Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    shift = places.groupBy(key, "_bin").agg(F.sum(1 - F.col("_asks")).alias("_sum")).select(key, "_bin", F.coalesce(before, F.lit(0)).alias("_shift"))
    numbers = places.withColumn("_in", inside).join(shift, [key, "_bin"]).select(key, "_at", "_asks", (F.col("_in") + F.col("_shift")).alias("_number"))
    # The edges that a limit may reach, of the n numbers up to its own.
    ask = numbers.where("_asks = 1").select(key, F.col("_at").alias("_limit"), F.explode(F.sequence(F.col("_number") - (n - 1), F.col("_number"))).alias("_number"))
    near = ask.join(numbers.where("_asks = 0").select(key, F.col("_at").alias("_edge"), "_number"), [key, "_number"])
    near = near.withColumn("distance", F.col("_limit") - F.col("_edge")).where(F.col("distance") < max_dist).drop("_number")
    hits = q.join(near, [key, "_limit"]).join(t, [key, "_edge"]).drop("_limit", "_edge")
    order = Window.partitionBy(query).orderBy("distance", *others)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def nearest_interval(queries: DataFrame, targets: DataFrame, side: str, n: int = 1, max_dist: int = 2500, key: str = "seqid", query: str = "q") -> DataFrame:
    """Nearest targets of query intervals: before, after, or by their strand upstream, downstream.

    Upstream is before, and after on the minus strand; downstream the other way round.  Query columns
    start and end become q_start and q_end.
    """
    q = queries.withColumnsRenamed({"start": "q_start", "end": "q_end"})
    if side in ("before", "after"):
        return nearest(q.withColumn("pos", F.col("q_start" if side == "before" else "q_end")), targets, side, n, max_dist, key, query)
    minus = F.coalesce(F.col("strand") == "-", F.lit(False))
    first, second = ("after", "before") if side == "upstream" else ("before", "after")
    parts = []
    for mask, way in ((minus, first), (~minus, second)):
        part = q.where(mask).withColumn("pos", F.col("q_start" if way == "before" else "q_end"))
        parts.append(nearest(part, targets, way, n, max_dist, key, query))
    return parts[0].unionByName(parts[1])


def bounds(df: DataFrame, group: list[str], key: str = "seqid") -> DataFrame:
    """Start, end and the distinct strands of each group; an error if a group lies on two sequences."""
    found = df.groupBy(*group).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("strand")).alias("strands"), F.min(key).alias("_a"), F.max(key).alias("_b"))
    whole = F.when(F.col("_a") == F.col("_b"), F.col("start")).otherwise(F.raise_error(F.lit("a group lies on two sequences")).cast("long"))
    return found.withColumn("start", whole).drop("_a", "_b")


def in_order(df: DataFrame, key: str = "seqid") -> DataFrame:
    """Intervals in the order of sequence, start and end, range-partitioned."""
    order = [key, "start", "end", *[c for c in df.columns if c not in (key, "start", "end")]]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def located(df: DataFrame, spans: DataFrame, columns: list[str], key: str = "seqid") -> DataFrame:
    """Rows with ``columns`` of the span (locus, cluster) that holds their start."""
    at = df.withColumn("_end", F.col("end")).withColumn("end", F.col("start") + 1)
    hit = overlap_join(at, spans, key).withColumn("end", F.col("_end"))
    return hit.select(*df.columns, *[F.col(f"r_{c}").alias(c) for c in columns])


def write_located(df: DataFrame, path: str, buckets: int = 256) -> None:
    """Rows with a ``locus_id``, in folders by its hash: reading one locus opens one of them."""
    df.withColumn("bucket", F.pmod(F.crc32(F.col("locus_id").cast("binary")), F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_locus(spark: SparkSession, path: str, locus_id: str, buckets: int = 256) -> DataFrame:
    """The rows of one locus, from one folder."""
    bucket = zlib.crc32(locus_id.encode()) % buckets
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("locus_id") == locus_id)).drop("bucket")
