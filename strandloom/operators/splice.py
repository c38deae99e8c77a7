"""Splice graphs: node boundaries, paths of transcripts, k-mers, strand evidence and imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..durable import cut
from . import coverage
from .intervals import merge_islands, overlap_join


def boundaries(exons: DataFrame, keys: list[str], seq: str = "seqid", tile: int = 4096) -> DataFrame:
    """Ends of the graph, splice sites, and places where coverage starts or stops.

    Exons are written once and read by the three branches; all of coverage that counts here is where
    the merged exons begin and end.
    """
    return _ends(cut(exons.select(*dict.fromkeys([*keys, seq, "start", "end", *({"expr"} & set(exons.columns))])), "exons"), keys, seq, tile)


def _ends(exons: DataFrame, keys: list[str], seq: str = "seqid", tile: int = 4096) -> DataFrame:
    covered = merge_islands(exons.where("expr > 0") if "expr" in exons.columns else exons, [seq], closed=True, tile=tile)
    outer = exons.groupBy(seq).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    sites = coverage.introns(exons, keys).select(seq, "start", "end")
    every = covered.select(seq, "start", "end").unionByName(outer).unionByName(sites)
    return every.select(seq, F.explode(F.array("start", "end")).alias("pos")).distinct()


def nodes(bounds: DataFrame, seq: str = "seqid") -> DataFrame:
    """Intervals between neighbouring boundaries."""
    w = Window.partitionBy(seq).orderBy("pos")
    return bounds.select(seq, F.col("pos").alias("start"), F.lead("pos").over(w).alias("end")).where("`end` IS NOT NULL")


def split_transfrags(exons: DataFrame, node: DataFrame) -> DataFrame:
    """A row for each exon and node that overlap: the exon's columns, node_start and node_end."""
    hits = overlap_join(exons, node)
    return hits.withColumnsRenamed({"r_start": "node_start", "r_end": "node_end"}).drop("r_seqid")


def on_nodes(exons: DataFrame, keys: list[str]) -> DataFrame:
    """``split_transfrags`` by the nodes of the exons' own boundaries; exons are made and written once for both."""
    exons = cut(exons, "exons")
    return split_transfrags(exons, nodes(_ends(exons, keys)))


def splice_sites(exons: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct ends of introns."""
    return coverage.introns(exons, keys).select("seqid", F.explode(F.array("start", "end")).alias("pos")).distinct()


def kmers(paths: DataFrame, k: int, path: str = "path") -> DataFrame:
    """K-mers of array paths with their place; shorter paths have none."""
    made = F.expr(f"CASE WHEN size({path}) >= {k} THEN transform(sequence(0, size({path}) - {k}), i -> slice({path}, i + 1, {k})) ELSE array() END")
    return paths.select("*", F.posexplode(made).alias("at", "kmer"), (F.size(path) - k).alias("last_at"))


def kmer_expression(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Summed expression of equal k-mers, and of those that begin or end a path."""
    return rows.groupBy(*keys, "kmer").agg(
        F.sum("expr").alias("expr"),
        F.sum(F.when(F.col("at") == 0, F.col("expr")).otherwise(0)).alias("smooth_rev"),
        F.sum(F.when(F.col("at") == F.col("last_at"), F.col("expr")).otherwise(0)).alias("smooth_fwd"),
    )


def rescued(kmer: DataFrame, short: DataFrame, keys: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """(gains, lost) of short paths (keys, id, path, expr) among k-mers (keys, kmer, expr) that contain them.

    A short path's expression is shared in proportion to its k-mers' expression, equally if that is 0;
    paths in no k-mer are lost.  Runs of each k-mer meet short paths in an equality join.
    """
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda m: F.transform(F.sequence(F.lit(1), F.lit(k) - m + 1), lambda i: F.slice("kmer", i, m))))
    parts = kmer.select(*keys, "kmer", F.col("expr").alias("_weight"), F.explode(F.array_distinct(runs)).alias("path"))
    hit = short.join(parts, [*keys, "path"])
    every = Window.partitionBy(*keys, "id")
    total = F.sum("_weight").over(every)
    share = F.when(total > 0, F.col("expr") * F.col("_weight") / total).otherwise(F.col("expr") / F.count(F.lit(1)).over(every))
    gains = hit.select(*keys, "kmer", share.alias("gain")).groupBy(*keys, "kmer").agg(F.sum("gain").alias("gain"))
    return gains, short.join(parts.select(*keys, "path").distinct(), [*keys, "path"], "left_anti")


def reconstructed(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Exons of paths of nodes (keys, start, end): nodes that touch are joined."""
    w = Window.partitionBy(*keys).orderBy("start")
    marked = paths.withColumn("_new", F.when(F.lag("end").over(w) == F.col("start"), 0).otherwise(1)).withColumn("_exon", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_exon").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_exon")


def strand_evidence(exons: DataFrame, keys: list[str]) -> DataFrame:
    """For unstranded transcripts, whether any exon overlaps a stranded exon of either strand.

    References, whose expression is zero, are evidence like any other: intervals count, not sums.
    """
    plain = exons.where("strand = '.'").select(*keys, "seqid", "start", "end")
    known = merge_islands(exons.where("strand <> '.'"), ["seqid", "strand"], closed=True)
    hits = overlap_join(plain, known).groupBy(*keys).agg(F.max(F.col("r_strand") == "+").alias("plus"), F.max(F.col("r_strand") == "-").alias("minus"))
    return plain.select(*keys).distinct().join(hits, keys, "left").select(*keys, F.coalesce("plus", F.lit(False)).alias("plus"), F.coalesce("minus", F.lit(False)).alias("minus"))


def impute_strands(exons: DataFrame, keys: list[str]) -> DataFrame:
    """Give unstranded transcripts the only strand they overlap, round by round, to a fixpoint."""
    now = cut(exons, "strands")
    while not now.where("strand = '.'").isEmpty():
        seen = strand_evidence(now, keys).where("plus <> minus").select(*keys, F.when(F.col("plus"), "+").otherwise("-").alias("_s"))
        seen = cut(seen, "decided")
        if seen.isEmpty():
            break
        now = cut(now.join(seen, keys, "left").withColumn("strand", F.coalesce("_s", "strand")).drop("_s"), "strands")
    return now
