"""Annotation text: GTF lines, bedgraph rows, manifests and locus indexes, parsed and written natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: What a file's lines are ordered by: the file, the block a task reads, the place in it.
LINE = ["file", "block", "place"]


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, file, block, place): lines with what orders them, without a shuffle."""
    lines = spark.read.text(list(paths))
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def _fields(lines: DataFrame, column: str) -> DataFrame:
    """Fields ``f`` of the lines that are neither blank nor comments; other columns are kept."""
    text = lines.where((F.trim(column) != "") & ~F.col(column).startswith("#"))
    return text.withColumn("f", F.split(F.rtrim(column), "\t"))


def _sound() -> Column:
    f = F.col("f")
    return (F.size("f") >= 9) & f[3].try_cast("long").isNotNull() & f[4].try_cast("long").isNotNull()


def parse_gtf(lines: DataFrame, column: str = "value") -> DataFrame:
    """Features of GTF lines: 0-based half-open coordinates and a map of attributes.

    Blank lines, comments, and lines with fewer than nine fields or coordinates that are no numbers
    are skipped (``gtf_rejects`` has the latter two).  Of attributes with one key the last counts; a
    lone dot means no attributes.  Other columns of the input are kept.
    """
    others = [c for c in lines.columns if c != column]
    text = _fields(lines, column).where(F.coalesce(_sound(), F.lit(False)))
    parts = F.filter(F.transform(F.split(F.try_element_at("f", F.lit(9)), ";"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "."))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(\S+)", 1), F.trim(F.regexp_replace(x, r'^\S+\s*|"', "")))
    pairs = F.transform(parts, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["col1"] == p["col1"]))
    f = F.col("f")
    return text.select(
        f[0].alias("seqid"), f[1].alias("source"), f[2].alias("feature"), (f[3].try_cast("long") - 1).alias("start"), f[4].try_cast("long").alias("end"),
        f[5].alias("score"), f[6].alias("strand"), f[7].alias("phase"), F.map_from_entries(last).alias("attrs"), *others,
    )


def gtf_rejects(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are neither blank nor comments and that ``parse_gtf`` cannot read."""
    return _fields(lines, column).where(~F.coalesce(_sound(), F.lit(False))).drop("f")


def gtf_attributes(attrs: list[tuple[str, Column]]) -> Column:
    """``key "value";`` of the attributes that are not null."""
    return F.concat_ws(" ", *[F.concat(F.lit(k + ' "'), c.cast("string"), F.lit('";')) for k, c in attrs])


def gtf_line(attrs: list[tuple[str, Column]], source: str = "strandloom") -> Column:
    """A GTF line of columns seqid, feature, start, end, score, strand and named attributes."""
    return gtf_row(gtf_attributes(attrs), source)


def gtf_row(attributes: Column, source: str = "strandloom") -> Column:
    """As ``gtf_line``, of attributes that are already text."""
    return F.concat_ws("\t", F.col("seqid").cast("string"), F.lit(source), "feature", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.col("score").cast("string"), "strand", F.lit("."), attributes)


def sorted_features(features: DataFrame) -> DataFrame:
    """Features by sequence, start, and transcripts before exons, range-partitioned in that order."""
    order = ["seqid", "start", F.desc("feature"), "end", "strand"]
    return features.repartitionByRange(*order).sortWithinPartitions(*order)


def read_gtf(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_gtf(spark.read.text(list(paths)))


def parse_bedgraph(lines: DataFrame, column: str = "value") -> DataFrame:
    """(seqid, start, end, value) of bedgraph lines; track, browser, comment and broken lines are skipped."""
    text = lines.where(~F.col(column).rlike(r"^(track|browser)(\s|$)|^#|^\s*$")).select(F.split(F.trim(column), r"\s+").alias("f"))
    f = F.col("f")
    rows = text.where(F.size("f") >= 4).select(f[0].alias("seqid"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("end"), f[3].try_cast("double").alias("value"))
    return rows.where("start IS NOT NULL AND `end` IS NOT NULL AND value IS NOT NULL")


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return parse_bedgraph(spark.read.text(path))


def bedgraph_line() -> Column:
    return F.concat_ws("\t", F.col("seqid").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), F.format_string("%f", "value"))


def write_bedgraph(runs: DataFrame, path: str, mode: str = "error") -> None:
    """Runs as bedgraph text in global order, one folder for each strand."""
    text = runs.repartitionByRange("seqid", "start").sortWithinPartitions("seqid", "start")
    text.select("strand", bedgraph_line().alias("value")).write.mode(mode).partitionBy("strand").text(path)


def parse_manifest(lines: DataFrame, order: list[str], column: str = "value", header: bool = False) -> DataFrame:
    """(gtf, sample_id) of lines ``file[<tab>id]``: the n-th file without an id gets the id n.

    A manifest is a list of files for people to write, so one window over its lines is meant.
    """
    rows = lines.where(F.trim(column) != "").withColumn("f", F.split(F.trim(column), "\t"))
    if header:
        rows = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where("_n > 1")
    own = F.nullif(F.try_element_at("f", F.lit(2)), F.lit(""))
    auto = F.sum(F.when(own.isNull(), 1).otherwise(0)).over(Window.orderBy(*order))
    return rows.select(F.col("f")[0].alias("gtf"), F.coalesce(own, auto.cast("string")).alias("sample_id"))


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(problem, name): files and sample ids that occur more than once."""
    found = [manifest.groupBy(F.col(c).alias("name")).count().where("count > 1").select(F.lit(what).alias("problem"), "name") for c, what in (("gtf", "file is not unique"), ("sample_id", "sample_id is not unique"))]
    return found[0].unionByName(found[1])


def read_manifest(spark: SparkSession, path: str, header: bool = False, check: bool = True) -> DataFrame:
    """The manifest; with ``check``, files must be distinct and readable and ids distinct."""
    found = parse_manifest(read_lines(spark, path), LINE, header=header)
    if check:
        bad = manifest_problems(found).first()
        if bad:
            raise ValueError(f"{bad['problem']}: {bad['name']}")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for row in found.select("gtf").toLocalIterator():
            at = jvm.org.apache.hadoop.fs.Path(row["gtf"])
            if not at.getFileSystem(conf).exists(at):
                raise ValueError(f"file is not valid: {row['gtf']}")
    return found


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select("gtf", "sample_id").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def locus_line() -> Column:
    """The tab-separated line of a row of ``intervals.loci``."""
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in ("locus_id", "seqid", "start", "end", "n_features")])


def read_locus_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="locus_id string, seqid string, start long, end long, n_features long")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


write_gtf = write_lines
