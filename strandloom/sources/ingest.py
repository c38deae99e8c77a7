"""From sample files to transfrags: filter, new ids, the join of exons to them, union, checks.

Transcripts are numbered inside each file's blocks and shifted by the counts of the blocks before, so
that a large file is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..durable import cut
from .text import LINE, gtf_row, parse_gtf, read_lines

REFERENCE = "R"


def sample_features(spark: SparkSession, manifest: DataFrame, reference: str | None = None) -> DataFrame:
    """Features of all files of a manifest (gtf, sample_id), and of a reference file, with sample and place."""
    files = [(r["gtf"], r["sample_id"]) for r in manifest.select("gtf", "sample_id").toLocalIterator()]
    files += [(reference, REFERENCE)] if reference else []
    lines = read_lines(spark, *[f for f, _ in files])
    # Paths come back qualified; a manifest is small, so its names travel as a table.
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def qualified(name: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(name)
        return at.getFileSystem(conf).makeQualified(at).toUri().toString()

    names = spark.createDataFrame([(qualified(f), s) for f, s in files], "_file string, sample_id string")
    plain = F.regexp_replace("file", "^file:/+", "file:/")
    tagged = lines.join(names, plain == F.regexp_replace("_file", "^file:/+", "file:/")).drop("_file")
    return parse_gtf(tagged).withColumn("is_ref", F.col("sample_id") == REFERENCE)


def numbered_in(df: DataFrame, group: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """Positions 1..n in each group, in the order (block, order), without a window over a whole group.

    Blocks may be as many as rows, so their shifts are no table to broadcast; rows are dealt by (group,
    block) for their ranks anyway, and a join of sorted partitions takes them as they lie.
    """
    counts = df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*group, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy(*group, block).orderBy(*order))
    return df.withColumn("_rank", rank).join(shift.hint("merge"), [*group, block]).withColumn(name, F.col("_rank") + F.col("_shift")).drop("_rank", "_shift")


def aggregated(features: DataFrame, expr_attr: str = "FPKM", order: list[str] = LINE) -> DataFrame:
    """Transcript and exon rows of all samples under ids ``<sample>.T<n>``, n in the order of the file.

    Columns: seqid, feature, start, end, strand, tx, sample_id, is_ref, expr, and ``problem``: null, or
    what is wrong with the row (an id that is not unique, an exon without a transcript, a missing id or
    expression).  A reference's expression is 0.

    What is needed of the features is written once, so that lines are parsed once and not for each use of
    them.  Ids are as many as transcripts, too many to broadcast, whatever a planner that does not know how
    many lines come of a file takes them for.
    """
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    kept = features.where(F.col("feature").isin("transcript", "exon")).select("seqid", "feature", "start", "end", "strand", "sample_id", "is_ref", *order[-2:], attr("transcript_id").alias("old"), attr(expr_attr).try_cast("double").alias("expr"))
    kept = cut(kept, "kept")
    block, place = order[-2:]
    heads = kept.where("feature = 'transcript'")
    heads = numbered_in(heads, ["sample_id"], block, [place], "n") if len(order) > 1 else heads
    expr = F.when(F.col("is_ref"), F.lit(0.0)).otherwise(F.col("expr"))
    heads = heads.select("seqid", "feature", "start", "end", "strand", F.concat_ws(".T", "sample_id", F.col("n").cast("string")).alias("tx"), "sample_id", "is_ref", expr.alias("expr"), "old", "n")
    ids = heads.where("old IS NOT NULL").groupBy("sample_id", "old").agg(F.min(F.struct("n", "tx"))["tx"].alias("tx"), F.count(F.lit(1)).alias("times"))
    heads = heads.join(ids.select("sample_id", "old", "times").hint("merge"), ["sample_id", "old"], "left")
    problem = F.when(F.col("old").isNull(), "no transcript_id").when(F.col("times") > 1, "transcript_id is not unique").when(F.col("expr").isNull(), "no expression")
    columns = ["seqid", "feature", "start", "end", "strand", "tx", "sample_id", "is_ref", "expr", "problem"]
    heads = heads.withColumn("problem", problem).select(columns)
    exons = kept.where("feature = 'exon'").select("seqid", "feature", "start", "end", "strand", "sample_id", "is_ref", "old", F.lit(None).cast("double").alias("expr"))
    exons = exons.join(ids.hint("merge"), ["sample_id", "old"], "left")
    exons = exons.withColumn("problem", F.when(F.col("tx").isNull(), "exon without a transcript")).select(columns)
    return heads.unionByName(exons)


def attributes() -> Column:
    """The normalised attributes of a row of ``aggregated``."""
    text = lambda k, c: F.concat(F.lit(f'{k} "'), c, F.lit('";'))
    tx = text("transcript_id", F.col("tx"))
    head = F.concat_ws(" ", text("expr", F.col("expr").cast("string")), tx, text("ref", F.col("is_ref").cast("int").cast("string")), text("sample_id", F.col("sample_id")))
    return F.when(F.col("feature") == "transcript", head).otherwise(tx)


def aggregated_line() -> Column:
    return gtf_row(attributes())


def transfrags_of(rows: DataFrame) -> DataFrame:
    """One row a transcript of ``aggregated`` or equal columns: exons in order, expr 0 and is_ref false by default.

    Rows with a problem are left out; so is a transcript without exons.
    """
    sound = rows.where("problem IS NULL") if "problem" in rows.columns else rows
    exon = F.when(F.col("feature") == "exon", F.struct("start", "end"))
    t = sound.groupBy("seqid", "strand", "tx").agg(
        F.array_sort(F.collect_list(exon)).alias("exons"),
        F.max("sample_id").alias("sample_id"),
        F.coalesce(F.max("expr"), F.lit(0.0)).alias("expr"),
        F.coalesce(F.max("is_ref"), F.lit(False)).alias("is_ref"),
    )
    t = t.where(F.size("exons") > 0)
    length = F.aggregate("exons", F.lit(0).cast("long"), lambda a, e: a + (e["end"] - e["start"]).cast("long"))
    return t.select("seqid", "strand", "tx", "sample_id", "expr", "is_ref", F.col("exons")[0]["start"].alias("start"), F.element_at("exons", -1)["end"].alias("end"), length.alias("length"), "exons")


def checked(rows: DataFrame) -> DataFrame:
    """The rows, after an error if one of them has a problem."""
    bad = rows.where("problem IS NOT NULL").first()
    if bad:
        raise ValueError(f"{bad['problem']}: {bad['tx']} of sample {bad['sample_id']} at {bad['seqid']}:{bad['start']}-{bad['end']}")
    return rows
