"""Transcripts: building from exon rows, projections, filters, re-keying and text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def transfrags(exons: DataFrame, keys: list[str], total: Column | None = None) -> DataFrame:
    """One row a transcript: sorted exons, start, end, length and summed expression (or ``total``)."""
    expr = F.sum("expr") if total is None else total
    t = exons.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"), expr.alias("expr"))
    length = F.aggregate("exons", F.lit(0).cast("long"), lambda a, e: a + (e["end"] - e["start"]).cast("long"))
    return t.select(*keys, F.col("exons")[0]["start"].alias("start"), F.element_at("exons", -1)["end"].alias("end"), length.alias("length"), "expr", "exons")


def filtered(t: DataFrame, min_length: int = 200, min_expr: float = 0.5, keep_ref: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) transcripts; references are held to the same limits unless told otherwise."""
    good = (F.col("length") >= min_length) & (F.col("expr") >= min_expr)
    if keep_ref:
        good = good | F.col("is_ref")
    return t.where(good), t.where(~good)


def tss(strand: str = "strand") -> Column:
    """The strand-aware start of transcription."""
    return F.when(F.col(strand) == "-", F.col("end")).otherwise(F.col("start"))


def stop(strand: str = "strand") -> Column:
    return F.when(F.col(strand) == "-", F.col("start")).otherwise(F.col("end"))


def rekeyed(rows: DataFrame, sample: str, order: list[str]) -> DataFrame:
    """Ids ``<sample>.T<n>`` in the order of each sample."""
    n = F.row_number().over(Window.partitionBy(sample).orderBy(*order))
    return rows.withColumn("transcript_id", F.concat(F.col(sample).cast("string"), F.lit(".T"), n.cast("string")))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bed12(name: Column, score: Column) -> Column:
    """A BED12 line of seqid, strand, start, end and exons, which must be in order."""
    first, last, n = F.col("exons")[0], F.element_at("exons", -1), F.size("exons")
    ordered = F.forall(F.slice("exons", 2, n), lambda e: e["start"] > first["start"]) & F.forall(F.slice("exons", 1, n - 1), lambda e: e["end"] < last["end"])
    sizes = F.concat(F.array_join(F.transform("exons", lambda e: (e["end"] - e["start"]).cast("string")), ","), F.lit(","))
    starts = F.concat(F.array_join(F.transform("exons", lambda e: (e["start"] - F.col("start")).cast("string")), ","), F.lit(","))
    s = lambda c: F.col(c).cast("string")
    line = F.concat_ws("\t", s("seqid"), s("start"), s("end"), name, score.cast("string"), "strand", s("start"), s("start"), F.lit("0"), F.size("exons").cast("string"), sizes, starts)
    return F.when(ordered, line).otherwise(F.raise_error(F.lit("exons are not in order")))


def fractions(paths: DataFrame, gene: str, expr: str = "expr") -> DataFrame:
    """Shares of a gene's best and of its total expression, and the rank in the gene."""
    w = Window.partitionBy(gene)
    order = w.orderBy(F.desc(expr), *[c for c in paths.columns if c not in (gene, expr)])
    return (
        paths.withColumn("rel_frac", F.col(expr) / F.max(expr).over(w))
        .withColumn("abs_frac", F.col(expr) / (F.sum(expr).over(w) + 1e-10))
        .withColumn("rank", F.row_number().over(order))
    )
