"""The assembly plan, end to end: sample files to transfrags, loci, strands, graphs, isoforms, outputs.

What is large (features, coverage, junctions, strands, ids) stays relational.  A kernel sees one row:
the transfrags of one strand of one locus.  It splits them into connected graphs, finds change points,
and assembles each graph; its findings of all kinds are written once and read as tables.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..durable import cut
from ..functions import changepoints, paths
from ..functions.splicegraph import SpliceGraph
from ..operators import coverage, intervals, splice
from ..operators.transcripts import bed12, filtered, transfrags
from ..sources import ingest, text


@dataclass(frozen=True)
class Options:
    """Job options and their defaults."""

    gtf_expr_attr: str = "FPKM"
    min_transfrag_length: int = 200
    min_expr: float = 0.5
    #: References are marked on their strand with or without it, so it changes nothing.
    guided_strand: bool = False
    guided_ends: bool = False
    guided_assembly: bool = False
    #: References keep clear of the limits of length and expression.
    keep_ref: bool = False
    isoform_frac: float = 0.05
    max_isoforms: int = 0
    change_point: bool = True
    change_point_pvalue: float = 0.001
    change_point_fold_change: float = 0.85
    change_point_trim: bool = True
    #: Leave segments' offsets out of change intervals.
    compat: bool = False
    path_kmax: int = 0
    path_graph_loss_threshold: float = 0.10
    #: Only with it does the loss threshold rule a k out.
    limit_loss: bool = False
    path_frac: float = 0.0
    max_paths: int = 0

    def __post_init__(self):
        for name in ("isoform_frac", "change_point_pvalue", "change_point_fold_change", "path_graph_loss_threshold", "path_frac"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} out of range (0.0-1.0)")
        for name in ("min_transfrag_length", "min_expr", "max_isoforms", "path_kmax", "max_paths"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} < 0")


STATS = ["k", "kmax", "transfrags", "kmers", "short_transfrags", "lost_kmers", "tot_expr", "lost_expr", "lost_expr_frac", "valid"]
#: Findings of the kernel: kind, the graph, and what each kind fills.
FOUND = pa.schema(
    [("kind", pa.string()), ("seqid", pa.string()), ("strand", pa.string()), ("locus", pa.int64()), ("graph_start", pa.int64()), ("graph_end", pa.int64())]
    + [("start", pa.int64()), ("end", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("mean", pa.float64()), ("is_start", pa.bool_()), ("is_stop", pa.bool_()), ("ref_starts", pa.list_(pa.int64())), ("ref_stops", pa.list_(pa.int64()))]
    + [("pos", pa.int64()), ("pvalue", pa.float64()), ("foldchange", pa.float64()), ("sign", pa.int32())]
    + [("gene", pa.int64()), ("rank", pa.int64()), ("exons", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("expr", pa.float64()), ("rel_frac", pa.float64()), ("abs_frac", pa.float64())]
    + [(c, pa.float64() if "expr" in c else pa.int64()) for c in STATS]
)
_TYPES = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
COMMON = {"kind", "seqid", "strand", "locus", "graph_start", "graph_end"}
OF = {
    "node": ["start", "end", "low", "high", "mean", "is_start", "is_stop", "ref_starts", "ref_stops"],
    "changept": ["start", "end", "pos", "pvalue", "foldchange", "sign"],
    "transfrag": ["start", "end", "exons", "expr"],
    "k": STATS,
    "isoform": ["start", "end", "gene", "rank", "exons", "expr", "rel_frac", "abs_frac"],
}


def placed(t: DataFrame) -> DataFrame:
    """Transfrags with ``locus``, the first base of the run of overlapping transfrags they are in.

    Runs are of a sequence, over all strands; a transfrag is in the run that holds its start.  Runs may be
    as many as genes, too many to broadcast.
    """
    runs = intervals.merge_islands(t, ["seqid"]).withColumn("locus", F.col("start"))
    at = t.select("*", F.struct("start", "end").alias("_whole")).withColumn("end", F.col("start") + 1)
    hit = intervals.overlap_join(at, runs.hint("merge")).withColumn("start", F.col("_whole.start")).withColumn("end", F.col("_whole.end"))
    return hit.select(*t.columns, F.col("r_locus").alias("locus"))


def by_graph(t: DataFrame) -> DataFrame:
    """A row for each locus and strand: its transfrags in order of id.

    A row is what a kernel must see whole; many rows travel in one Arrow batch.  The number of
    partitions is given, because a kernel's work is not in proportion to its bytes: adaptive execution
    would put small rows of much work together.
    """
    member = F.struct("tx", "expr", "is_ref", "exons")
    partitions = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return t.repartition(partitions, "seqid", "strand", "locus").groupBy("seqid", "strand", "locus").agg(F.array_sort(F.collect_list(member)).alias("t"))


#: Nodes before change points, change points, transfrags as trimmed by them, tried ks, isoforms.
KINDS = ("node", "changept", "transfrag", "k", "isoform")


def graph_rows(graph: SpliceGraph, options: Options, kinds: tuple[str, ...] = KINDS) -> list[dict]:
    """Findings of one connected splice graph, of the given kinds."""
    o = options
    rows: list[dict] = []
    place = {"graph_start": graph.start, "graph_end": graph.end}
    for n in graph.node_rows() if "node" in kinds else ():
        node = (n["start"], n["end"])
        rows.append({"kind": "node", **place, **n, "is_start": node in graph.is_start, "is_stop": node in graph.is_stop})
    if o.change_point:
        for c in graph.refine(o.change_point_pvalue, o.change_point_fold_change, o.change_point_trim, o.compat):
            rows.append({"kind": "changept", **place, **{k: c[k] for k in ("start", "end", "pos", "pvalue", "foldchange", "sign")}})
    for t in graph.own if "transfrag" in kinds else ():
        exons = [{"start": a, "end": b} for a, b in t["exons"]]
        rows.append({"kind": "transfrag", **place, "exons": exons, "start": exons[0]["start"], "end": exons[-1]["end"], "expr": t["expr"]})
    if not {"k", "isoform"} & set(kinds):
        return rows
    walks = graph.paths()
    alone = paths.lone(walks, graph.minus) if "k" not in kinds else None
    found, tried = (alone, []) if alone else paths.assemble(walks, graph.minus, o.isoform_frac, o.max_isoforms, o.path_kmax, o.path_frac, o.max_paths, o.path_graph_loss_threshold if o.limit_loss else None)
    rows += [{"kind": "k", **place, **r} for r in tried] if "k" in kinds else []
    for r in found if "isoform" in kinds else ():
        exons = [{"start": a, "end": b} for a, b in r["exons"]]
        rows.append({"kind": "isoform", **place, **r, "exons": exons, "start": exons[0]["start"], "end": exons[-1]["end"]})
    return rows


def findings(t: DataFrame, options: Options = Options(), kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Rows of FOUND for transfrags (seqid, strand, tx, expr, is_ref, start, end, exons, locus)."""
    schema = FOUND if len(kinds) > 1 else pa.schema([f for f in FOUND if f.name in COMMON | set(OF[kinds[0]])])
    ddl = ", ".join(f"`{f.name}` {_TYPES.get(f.type, 'array<struct<start:long,end:long>>')}" for f in schema)

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for g in batch.to_pylist():
                members = [{"exons": [(e["start"], e["end"]) for e in m["exons"]], "expr": float(m["expr"]), "is_ref": m["is_ref"]} for m in g["t"]]
                key = {k: g[k] for k in ("seqid", "strand", "locus")}
                key["seqid"] = str(key["seqid"])
                for part in SpliceGraph(members, g["strand"] == "-", options.guided_ends, options.guided_assembly).components():
                    rows += [key | r for r in graph_rows(part, options, kinds)]
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return by_graph(t).mapInArrow(run, ddl)


@dataclass(frozen=True)
class Assembly:
    """Tables of a run."""

    rejects: DataFrame  # transfrags below the limits
    transfrags: DataFrame  # kept ones, with locus and imputed strand
    found: DataFrame  # rows of FOUND

    def of(self, kind: str) -> DataFrame:
        return self.found.where(F.col("kind") == kind)

    def coverage(self) -> DataFrame:
        """Runs of summed expression by strand."""
        return coverage.runs(self._exons(), ["seqid", "strand"])

    def junctions(self) -> DataFrame:
        return coverage.junctions(self._exons(), ["seqid", "tx"])

    def _exons(self) -> DataFrame:
        return self.transfrags.select("seqid", "strand", "tx", "is_ref", "expr", F.inline("exons"))

    def isoforms(self) -> DataFrame:
        return assigned(self.of("isoform"))


def assembled(t: DataFrame, options: Options = Options()) -> Assembly:
    """Assemble transfrags (seqid, strand, tx, expr, is_ref, start, end, length, exons)."""
    kept, rejects = filtered(t, options.min_transfrag_length, options.min_expr, options.keep_ref)
    whole = kept.select("seqid", "strand", "tx", F.col("expr").cast("double").alias("expr"), "is_ref", F.inline("exons"))
    stranded = splice.impute_strands(whole, ["seqid", "tx"])
    t = transfrags(stranded, ["seqid", "strand", "tx", "is_ref"], total=F.first("expr"))
    t = cut(placed(cut(t, "transfrags")), "placed")
    return Assembly(rejects, t, cut(findings(t, options), "findings"))


def assigned(isoforms: DataFrame) -> DataFrame:
    """Isoforms with locus_id, gene_id, tss_id and transcript_id.

    Ids count loci, genes, starts of transcription in a gene and transcripts in the order of the genome:
    numbers inside a sequence, shifted by what the sequences before it hold.  Sequences may be as many as
    genes, too many to broadcast what they hold.
    """
    tss = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    rows = isoforms.select("seqid", "strand", "locus", "graph_start", "gene", "rank", "start", "end", "exons", "expr", "rel_frac", "abs_frac", tss.alias("_tss"))
    gene = ["locus", "strand", "graph_start", "gene"]
    inside = Window.partitionBy("seqid")
    rows = rows.withColumn("_first", F.min("rank").over(Window.partitionBy("seqid", *gene, "_tss")))
    ids = {"locus_id": ("L", ["locus"]), "gene_id": ("G", gene), "tss_id": ("TSS", [*gene, "_first"]), "transcript_id": ("TU", [*gene, "rank"])}
    for name, (_, order) in ids.items():
        rows = rows.withColumn(name, F.dense_rank().over(inside.orderBy(*order)))
    rows = cut(rows.drop("_tss", "_first"), "numbered")
    before = Window.orderBy("seqid").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("seqid").agg(*[F.max(n).alias(n) for n in ids])
    shifts = held.select("seqid", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in ids])
    numbered = {n: F.concat(F.lit(prefix), (F.col(n) + F.col(f"_{n}")).cast("string")) for n, (prefix, _) in ids.items()}
    return rows.join(shifts.hint("merge"), "seqid").withColumns(numbered).drop(*[f"_{n}" for n in ids])


def _score() -> Column:
    return F.round(1000 * F.col("rel_frac")).cast("int")


def assembly_rows(isoforms: DataFrame) -> DataFrame:
    """A transcript row and its exon rows, with score and the text of their attributes."""
    ids = text.gtf_attributes([(c, F.col(c)) for c in ("locus_id", "gene_id", "tss_id", "transcript_id")])
    numbers = text.gtf_attributes([("expr", F.format_string("%.3f", "expr")), ("rel_frac", F.format_string("%.5f", "rel_frac")), ("abs_frac", F.format_string("%.5f", "abs_frac"))])
    row = lambda feature, start, end, attrs: F.struct(F.lit(feature).alias("feature"), start.alias("start"), end.alias("end"), attrs.alias("attributes"))
    head = row("transcript", F.col("start"), F.col("end"), F.concat_ws(" ", numbers, ids))
    every = F.concat(F.array(head), F.transform("exons", lambda e: row("exon", e["start"], e["end"], ids)))
    return isoforms.select("seqid", "strand", _score().alias("score"), F.explode(every).alias("r")).select("seqid", "strand", "score", "r.*")


def assembly_gtf(isoforms: DataFrame) -> DataFrame:
    """GTF lines of the assembly in the order of the genome."""
    return text.sorted_features(assembly_rows(isoforms)).select(text.gtf_row(F.col("attributes")).alias("value"))


def assembly_bed(isoforms: DataFrame) -> DataFrame:
    """BED12 lines of the assembly in the order of the genome."""
    name = F.concat("gene_id", F.lit("|"), "transcript_id", F.lit("("), F.format_string("%.1f", "expr"), F.lit(")"))
    rows = isoforms.repartitionByRange("seqid", "start").sortWithinPartitions("seqid", "start")
    return rows.select(bed12(name, _score()).alias("value"))


def transfrag_gtf(t: DataFrame) -> DataFrame:
    """GTF lines of transfrags: a transcript row and its exon rows each."""
    return text.sorted_features(transfrag_rows(t)).select(text.gtf_row(F.col("attributes")).alias("value"))


def transfrag_rows(t: DataFrame) -> DataFrame:
    tx = text.gtf_attributes([("transcript_id", F.col("tx"))])
    sample = F.col("sample_id") if "sample_id" in t.columns else F.lit(None).cast("string")
    head = text.gtf_attributes([("transcript_id", F.col("tx")), ("sample_id", sample), ("expr", F.col("expr")), ("ref", F.col("is_ref").cast("int"))])
    row = lambda feature, start, end, attrs: F.struct(F.lit(feature).alias("feature"), start.alias("start"), end.alias("end"), attrs.alias("attributes"))
    every = F.concat(F.array(row("transcript", F.col("start"), F.col("end"), head)), F.transform("exons", lambda e: row("exon", e["start"], e["end"], tx)))
    return t.select("seqid", "strand", F.lit("0.0").alias("score"), F.explode(every).alias("r")).select("seqid", "strand", "score", "r.*")


def _graph_id() -> Column:
    return F.concat_ws("_", F.lit("G"), "seqid", F.col("graph_start").cast("string"), F.col("graph_end").cast("string"), "strand")


def graph_gtf(found: DataFrame) -> DataFrame:
    """GTF lines of nodes, and of change points as their place and their interval."""
    comma = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    node = text.gtf_attributes([("graph_id", _graph_id()), ("expr_min", F.col("low")), ("expr_max", F.col("high")), ("expr_mean", F.col("mean")), ("ref_starts", comma("ref_starts")), ("ref_stops", comma("ref_stops"))])
    point = text.gtf_attributes([("graph_id", _graph_id()), ("sign", F.col("sign")), ("pvalue", F.col("pvalue")), ("foldchange", F.col("foldchange"))])
    row = lambda feature, start, end, attrs: F.struct(F.lit(feature).alias("feature"), start.alias("start"), end.alias("end"), attrs.alias("attributes"))
    start, end, pos = F.col("start"), F.col("end"), F.col("pos")
    rows = F.when(F.col("kind") == "node", F.array(row("node", start, end, node))).otherwise(F.array(row("changept", pos, pos + 1, point), row("changeinterval", start, end, point)))
    exploded = found.where("kind IN ('node', 'changept')").select("seqid", "strand", F.lit("0").alias("score"), F.explode(rows).alias("r")).select("seqid", "strand", "score", "r.*")
    return text.sorted_features(exploded).select(text.gtf_row(F.col("attributes")).alias("value"))


def path_statistics(found: DataFrame) -> DataFrame:
    """A row for every k that the choice of k tried, by graph."""
    return found.where("kind = 'k'").select("seqid", F.col("graph_start").alias("start"), F.col("graph_end").alias("end"), "strand", *STATS)


def isoforms(exons: DataFrame, options: Options = Options()) -> DataFrame:
    """Isoforms of exon rows (seqid, strand, tx, start, end, expr) as they are, genes counted in each graph."""
    found = _plain(exons, options, "isoform")
    span = F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string"))), ",")
    return found.select(F.col("seqid").cast(exons.schema["seqid"].dataType).alias("seqid"), "strand", F.col("graph_start").alias("graph"), "gene", "rank", span.alias("exons"), "expr", "rel_frac", "abs_frac")


def _plain(exons: DataFrame, options: Options, kind: str) -> DataFrame:
    t = transfrags(exons, ["seqid", "strand", "tx"]).withColumn("is_ref", F.lit(False))
    return findings(placed(cut(t, "transfrags")), options, (kind,))


def plain_statistics(exons: DataFrame, options: Options = Options()) -> DataFrame:
    """``path_statistics`` of exon rows as they are."""
    stats = path_statistics(_plain(exons, options, "k")).withColumnRenamed("start", "graph").drop("end")
    return stats.withColumn("seqid", F.col("seqid").cast(exons.schema["seqid"].dataType))


def change_points(signal: DataFrame, options: Options = Options()) -> DataFrame:
    """Change points of every signal (key, pos, value), which one task must hold: a node's coverage, not a sequence's."""
    names = ["key", "pos", "start", "end", "dist_left", "dist_right", "pvalue", "foldchange", "sign"]

    def kernel(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("pos")["value"].to_numpy(np.float64)
        found = changepoints.change_points(values, options.change_point_pvalue, options.change_point_fold_change, compat=options.compat)
        return pd.DataFrame([{"key": key[0], **f} for f in found], columns=names)

    return signal.groupBy("key").applyInPandas(kernel, "key string, pos long, start long, end long, dist_left long, dist_right long, pvalue double, foldchange double, sign int")


STAGES = ("create", "aggregate", "index_loci", "assemble")


class Run:
    """A run in an output folder: every stage leaves its tables and its mark, and is skipped on resuming."""

    def __init__(self, spark: SparkSession, folder: str, options: Options | None = None, resume: bool = False):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._store = self._path("").getFileSystem(conf)
        self._jvm = jvm
        there = self._store.exists(self._path("args.json"))
        if resume:
            if not there:
                raise ValueError(f"{folder} holds no run to resume")
            self.options = Options(**json.loads(self._get("args.json")))
            self.status = json.loads(self._get("status.json"))
        else:
            if there:
                raise ValueError(f"{folder} already holds a run")
            self.options = options or Options()
            self.status = dict.fromkeys(STAGES, False)
            self._put("args.json", json.dumps(asdict(self.options)))
            self._done("create")

    def _get(self, name: str) -> str:
        with_ = self._store.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8")
        finally:
            with_.close()

    def _put(self, name: str, content: str) -> None:
        out = self._store.create(self._path(name), True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()

    def _done(self, stage: str) -> None:
        self.status[stage] = True
        self._put("status.json", json.dumps(self.status))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.table(name)

    def lines(self, df: DataFrame, name: str) -> None:
        df.select("value").write.mode("overwrite").text(f"{self.folder}/{name}")

    def run(self, manifest: DataFrame, reference: str | None = None) -> DataFrame:
        """Isoforms of the samples' files; all outputs are in the folder."""
        o = self.options
        if (o.guided_strand or o.guided_ends or o.guided_assembly) and not reference and not self.status["aggregate"]:
            raise ValueError("guided modes require a reference")
        if not self.status["aggregate"]:
            rows = ingest.aggregated(ingest.sample_features(self.spark, manifest, reference), o.gtf_expr_attr)
            self.keep(rows, "features")
            ingest.checked(self.table("features"))
            text.write_manifest(manifest, f"{self.folder}/samples.tsv")
            self._done("aggregate")
        if not self.status["index_loci"]:
            self.keep(intervals.loci(self.table("features")), "loci")
            self._done("index_loci")
        if not self.status["assemble"]:
            done = assembled(ingest.transfrags_of(self.table("features")), o)
            self.lines(transfrag_gtf(done.rejects), "transfrags_filtered.gtf")
            text.write_bedgraph(done.coverage(), f"{self.folder}/bedgraph", mode="overwrite")
            self.lines(done.junctions().select(coverage.junction_line().alias("value")), "splice_junctions.bed")
            self.lines(graph_gtf(done.found), "splice_graph.gtf")
            path_statistics(done.found).write.mode("overwrite").csv(f"{self.folder}/path_graph_stats.tsv", sep="\t", header=True)
            isoforms_ = self.keep(done.isoforms(), "isoforms")
            self.lines(assembly_gtf(isoforms_), "assembly.gtf")
            self.lines(assembly_bed(isoforms_), "assembly.bed")
            self._done("assemble")
        return self.table("isoforms")

