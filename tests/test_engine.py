"""Golden facts of the interval engine on literal fixtures."""

import numpy as np
import pytest

from strandloom.functions import arrays, changepoints, paths
from strandloom.functions.splicegraph import SpliceGraph
from pyspark.sql import functions as F

from strandloom.operators import coverage, graphs, intervals, signals, splice, statistics, transcripts
from strandloom.plans import assembly
from strandloom.sources import gtf, ingest, text


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_loci_touching_intervals_stay_apart(spark):
    df = spark.createDataFrame([("chr1", 10, 50), ("chr1", 50, 100), ("chr1", 99, 200), ("chr2", 100, 200)], "seqid string, start long, end long")
    assert rows(intervals.loci(df), "locus_id", "seqid", "start", "end") == [("L1", "chr1", 10, 50), ("L2", "chr1", 50, 200), ("L3", "chr2", 100, 200)]


def test_loci_across_tiles(spark):
    df = spark.createDataFrame([("a", 0, 9000), ("a", 4500, 4600), ("a", 8999, 9001), ("a", 9001, 9002)], "seqid string, start long, end long")
    assert rows(intervals.loci(df), "start", "end", "n_features") == [(0, 9001, 3), (9001, 9002, 1)]


def test_gap_clusters(spark):
    df = spark.createDataFrame([(1, 6, 7), (1, 1, 2), (1, 9, 10), (1, 3, 4), (1, 3, 8)], "k long, start long, end long")
    assert rows(intervals.clusters(df, ["k"], 0, 1), "start", "end", "n") == [(1, 2, 1), (3, 8, 3), (9, 10, 1)]


def test_coverage_of_path1(spark):
    a, b, c, d, e = [(i, i + 100) for i in range(0, 1000, 200)]
    data = [("+", s, t, x) for x, ex in ((10.0, (a, b, c, d, e)), (5.0, (a, c, e)), (2.0, (a, b, c, e)), (1.0, (a, c, d, e))) for s, t in ex]
    df = spark.createDataFrame(data, "strand string, start long, end long, expr double")
    want = [(0, 100, 18.0), (200, 300, 12.0), (400, 500, 18.0), (600, 700, 11.0), (800, 900, 18.0)]
    assert rows(coverage.runs(df, ["strand"]), "start", "end", "value") == want
    assert rows(coverage.runs(df, ["strand"], tile=64), "start", "end", "value") == want


def test_widest_paths_of_path1():
    a, b, c, d, e = [(i, i + 100) for i in range(0, 1000, 200)]
    graph = SpliceGraph([{"exons": list(x), "expr": v} for x, v in (([a, b, c, d, e], 10.0), ([a, c, e], 5.0), ([a, b, c, e], 2.0), ([a, c, d, e], 1.0))], False)
    found, _ = paths.assemble(graph.paths(), False)
    assert [round(r["expr"], 6) for r in found] == [11, 6, 1]
    assert [round(r["rel_frac"], 5) for r in found] == [1.0, 0.54545, 0.09091]
    walks = [((1, 2, 3, 4, 5), 10.0, True, True), ((1, 3, 5), 5.0, True, True), ((1, 2, 3, 5), 2.0, True, True), ((1, 3, 4, 5), 1.0, True, True)]
    assert [len(paths.kmer_graph(walks, k).live) - 2 for k in range(1, 6)] == [5, 6, 6, 5, 4]
    assert paths.choose_k(walks)[0] == 2


@pytest.mark.parametrize("minus", [False, True])
def test_a_lone_path_is_its_own_isoform(minus):
    for exons in ([(0, 10)], [(0, 10), (20, 30), (50, 55)]):
        walks = SpliceGraph([{"exons": exons, "expr": 3.0}], minus).paths()
        slow, _ = paths.assemble(walks, minus)
        assert [{**r, "exons": list(r["exons"])} for r in slow] == paths.lone(walks, minus)
    assert paths.lone([(((0, 1),), 0.0, True, True)], minus) is None


def test_disjoint_genes_are_separate_graphs(spark):
    found = []
    for gene, scale in ((0, 1000.0), (20000, 1.0)):
        a, b, c, d, e = [(gene + i, gene + i + 100) for i in range(0, 1000, 200)]
        found += [(x, scale * v) for x, v in (([a, b, c, d, e], 10.0), ([a, c, e], 5.0), ([a, b, c, e], 2.0), ([a, c, d, e], 1.0))]
    found.append(([(110, 190)], 2.0))  # in an intron of the strong gene: the same locus, another graph
    data = [(1, t, "+", s, e, x / len(ex)) for t, (ex, x) in enumerate(found) for s, e in ex]
    df = spark.createDataFrame(data, "seqid long, tx long, strand string, start long, end long, expr double")
    got = sorted((r["graph"], r["gene"], r["rank"], round(r["expr"], 6)) for r in assembly.isoforms(df).collect())
    assert got == [(0, 0, k, v * 1000) for k, v in enumerate((11, 6, 1))] + [(110, 0, 0, 2)] + [(20000, 0, k, v) for k, v in enumerate((11, 6, 1))]
    stats = assembly.plain_statistics(df).groupBy("graph").agg({"kmax": "max", "transfrags": "max"}).collect()
    assert sorted((r["graph"], r["max(kmax)"], r["max(transfrags)"]) for r in stats) == [(0, 5, 4), (110, 1, 1), (20000, 5, 4)]


def test_touching_exons_part_at_a_splice_site_only():
    whole = [{"exons": [(0, 10)], "expr": 1.0}, {"exons": [(10, 20)], "expr": 1.0}]
    parts = lambda ts: [len(g.own) for g in SpliceGraph(ts, False).components()]
    assert parts(whole) == [2]
    assert parts([{"exons": [(0, 10), (30, 40)], "expr": 1.0}, whole[1]]) == [1, 1]


def test_clusters_and_maximiser():
    data = [((1, 2, 3, 4), 1000), ((4, 5, 6), 1000), ((7, 8, 9), 100), ((6, 7), 1)]
    assert [(len(g), len(f)) for g, f in (paths.gene_clusters(data, 0.0), paths.gene_clusters(data, 0.01))] == [(1, 0), (2, 1)]
    assert paths.unimodal_maximum(lambda x: x, 1, 100)[0] == 100
    assert paths.unimodal_maximum(lambda x: -((x - 50) ** 2), 1, 100)[0] == 50


def test_change_points_of_a_ramp():
    x = np.concatenate([np.full(100, 250.0), np.arange(250, 50, -10.0), np.full(100, 50.0)])
    (found,) = changepoints.change_points(x)
    assert found["pos"] == 110 and found["sign"] == -1 and found["foldchange"] < 0.5
    assert changepoints.split_point(np.r_[np.full(50, 10.0), np.zeros(50)])[1] == 50
    assert changepoints.change_points(np.ones(5)) == []


def test_boundaries_and_threshold(spark):
    data = {1: [(10, 100), (200, 300), (400, 500)], 2: [(50, 100), (250, 300), (400, 500)], 3: [(150, 300), (400, 450)], 4: [(375, 525)]}
    df = spark.createDataFrame([(1, t, s, e, 1.0) for t, ex in data.items() for s, e in ex], "seqid long, tx long, start long, end long, expr double")
    assert [p for (p,) in rows(splice.boundaries(df, ["seqid", "tx"]), "pos")] == [10, 100, 150, 200, 250, 300, 375, 400, 525]


def test_imputed_strands(spark):
    data = [(1, "A", "+", 0, 10), (1, "B", ".", 4, 15), (1, "C", ".", 10, 20), (1, "D", ".", 15, 25), (1, "E", "-", 20, 30)]
    df = spark.createDataFrame([(*r, 1.0) for r in data], "seqid long, tx string, strand string, start long, end long, expr double")
    assert rows(splice.impute_strands(df, ["seqid", "tx"]), "tx", "strand") == [("A", "+"), ("B", "+"), ("C", "."), ("D", "-"), ("E", "-")]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8)], "src long, dst long")
    start, end = (spark.createDataFrame([(n,)], "node long") for n in (1, 3))
    assert rows(graphs.components(edges), "node", "component") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert rows(graphs.levels(edges), "node", "level") == [(1, 0), (2, 1), (3, 2), (7, 0), (8, 1)]
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 7, 8)], "node long")
    assert rows(graphs.unreachable(nodes, edges, start, end), "node") == [(7,), (8,)]
    assert graphs.is_valid(edges, start, end) and not graphs.is_valid(edges, end, start)
    order = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (7, 3), (8, 4)], "node long, pos long")
    assert graphs.is_topological(order, edges)
    with pytest.raises(ValueError):
        graphs.levels(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_statistics(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 2.0, 3.0, 2.0)], "k long, v double")
    got = rows(statistics.ranks(df, ["k"], "v"), "v", "rank_average", "rank_min", "rank_max", "rank_dense")
    assert got == [(0.0, 1.0, 1, 1, 1), (2.0, 2.5, 2, 3, 2), (2.0, 2.5, 2, 3, 2), (3.0, 4.0, 4, 4, 3)]
    assert statistics.tie_correction(df, ["k"], "v").first()["correction"] == pytest.approx(0.9)
    two = spark.createDataFrame([(1, "x", float(v)) for v in range(1, 6)] + [(1, "y", float(v)) for v in range(6, 11)], "k long, s string, v double")
    assert statistics.mann_whitney(two, ["k"], "s", "v").first()["u2"] == 0.0


def test_gtf_lines(spark):
    lines = ["# c", "", 'chr1\tt\texon\t11\t50\t0\t+\t.\ttranscript_id "A"; sample_id 1; expr "2.5"', "short\tline"]
    (r,) = text.parse_gtf(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert (r["start"], r["end"], r["attrs"]) == (10, 50, {"transcript_id": "A", "sample_id": "1", "expr": "2.5"})


def test_gtf_repeated_and_missing_attributes(spark):
    head = "chr1\tt\texon\t11\t50\t0\t+\t.\t"
    lines = [head + 'tag "x"; id "A"; tag "y";', head + "."]
    got = [r["attrs"] for r in text.parse_gtf(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert sorted(got, key=len) == [{}, {"id": "A", "tag": "y"}]


def test_permuted_steps_keep_the_sums_of_rises_and_falls():
    from strandloom.functions.changepoints import permuted_steps

    x = np.array([3.0, 3.0, 8.0, 8.0, 2.0, 4.0, 1.0, 1.0])
    rows = permuted_steps(x, rounds=50, seed=4)
    assert rows.shape == (50, 8) and (permuted_steps(x, 50, 4) == rows).all()
    # The last place has no rise after it and every fall before or at it.
    assert np.allclose(rows[:, -1], 3.0 - 9.0)
    assert rows.max() <= 3.0 + 7.0 and rows.min() >= 3.0 - 9.0


def test_smoothing_matches_convolution(spark):
    x = np.random.default_rng(1).random(40)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k long, pos long, value double")
    got = [r["smoothed"] for r in signals.smooth(df, ["k"]).orderBy("pos").collect()]
    w = np.hanning(11)
    padded = np.concatenate([x[5:0:-1], x, x[-2:-7:-1]])
    assert np.allclose(got, np.convolve(padded, w / w.sum(), "valid"))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "seqid long, tx long, strand string, start long, end long, expr double")
    assert intervals.loci(df).count() == coverage.runs(df, ["seqid"]).count() == splice.boundaries(df, ["seqid", "tx"]).count() == 0
    assert transcripts.transfrags(df, ["seqid", "tx"]).count() == 0


def test_coverage_of_fractions_is_decided_by_counts(spark):
    df = spark.createDataFrame([(1, 0, 10, 0.1), (1, 5, 15, 0.2), (1, 20, 30, 1.0), (1, 30, 40, 0.3), (1, 30, 40, 0.7), (1, 0, 50, 0.0)], "seqid long, start long, end long, expr double")
    got = [(r["start"], r["end"], round(r["value"], 9)) for r in coverage.runs(df, ["seqid"]).orderBy("start").collect()]
    assert got == [(0, 5, 0.1), (5, 10, 0.3), (10, 15, 0.2), (20, 40, 1.0)]
    one = df.withColumn("tx", F.monotonically_increasing_id()).where("expr > 0")
    assert [p for (p,) in rows(splice.boundaries(one, ["seqid", "tx"]), "pos")] == [0, 15, 20, 40]


def graph_of(data, minus=False, **options):
    return SpliceGraph([{"exons": list(e), "expr": x, "is_ref": r} for e, x, r in data], minus, **options)


def test_change_sites_make_nodes():
    data = [([(a, 200)], float(x), False) for a, x in ((50, 1), (60, 2), (70, 5), (80, 10), (90, 20), (100, 50))] + [([(95, 200)], 0.0, True)]
    graph = graph_of(data, guided_ends=False)
    assert graph.nodes == [(50, 200)] and (graph.ref_starts, graph.ref_stops) == ([95], [200])
    graph.starts.add(125)
    graph.build()
    assert graph.nodes == [(50, 125), (125, 200)] and (125, 200) in graph.is_start
    graph.stops.add(80)
    graph.build()
    assert graph.nodes == [(50, 80), (80, 125), (125, 200)] and (50, 80) in graph.is_stop
    assert graph_of(data, guided_ends=True).nodes == [(50, 95), (95, 200)]


MULTI = [("+", [(100, 200), (300, 400), (400, 650)], 1.0, False), ("+", [(150, 200), (300, 400), (500, 600)], 0.0, True), ("-", [(350, 500), (750, 900), (950, 1000)], 0.0, True), ("-", [(400, 500), (950, 980)], 1.0, False)]


def test_references_guide_boundaries():
    of = lambda s: [(e, x, r) for strand, e, x, r in MULTI if strand == s]
    plain = graph_of(of("+"))
    assert plain.bounds == [100, 200, 300, 400, 650]
    assert graph_of(of("-"), True).bounds == [350, 400, 500, 950, 980, 1000]
    guided = graph_of(of("+"), guided_ends=True, guided_assembly=True)
    assert {150, 500, 600} <= set(guided.bounds) and len(guided.paths()) == 2
    assert (150, 200) in guided.is_start and (500, 600) in guided.is_stop
    minus = graph_of(of("-"), True, guided_ends=True)
    assert minus.ref_starts == [1000] and minus.ref_stops == [350]
    only = graph_of([([(0, 10)], 0.0, True)])
    assert only.nodes == [] and only.paths() == []


@pytest.mark.parametrize("minus", [False, True])
@pytest.mark.parametrize("falls", [False, True])
def test_ramps_are_found_and_trimmed(minus, falls):
    spans = [((1000, 1220), 1.0)] * 50 + [((1000, 1100 + k) if falls else (1100 + k, 1220), 10.0) for k in range(20)]
    graph = graph_of([([s], x, False) for s, x in spans], minus)
    (point,) = graph.refine(0.05, 0.8)
    assert point["pos"] == 1110 and point["sign"] == (-1 if falls else 1) and point["foldchange"] < 0.5
    assert sorted(graph.stops if falls != minus else graph.starts) == [1110]
    levels = [graph.coverage(a, b)[0] for a, b in ((1000, 1001), (1109, 1110), (1110, 1111), (1219, 1220))]
    assert levels[0] == (250 if falls else 50) and levels[-1] == (50 if falls else 250) and levels[1] != levels[2]
    with pytest.raises(ValueError):
        graph.coverage(0, 10)


def test_smoothed_kernel_is_one_longer_and_late():
    x = np.arange(30.0)
    y = changepoints.smooth(x)
    assert len(y) == 31 and np.allclose(y[6:25], x[5:24])


def test_lines_and_bounds_refuse_what_is_broken(spark):
    t = spark.createDataFrame([("s", "+", 0, 9, [(5, 9), (0, 3)])], "seqid string, strand string, start long, end long, exons array<struct<start:long,end:long>>")
    with pytest.raises(Exception, match="not in order"):
        t.select(transcripts.bed12(F.lit("n"), F.lit("0"))).collect()
    two = spark.createDataFrame([(1, "a", "+", 0, 5), (1, "b", "-", 3, 9)], "g long, seqid string, strand string, start long, end long")
    assert rows(intervals.bounds(two.where("seqid = 'a'"), ["g"]), "start", "end", "strands") == [(0, 5, ["+"])]
    with pytest.raises(Exception, match="two sequences"):
        intervals.bounds(two, ["g"]).collect()


def test_rank_test_is_two_sided():
    u, p = changepoints.rank_test(np.arange(1.0, 6), np.arange(6.0, 11))
    assert (u, round(p, 4)) == (0.0, 0.0122)
    assert changepoints.rank_test(np.arange(1.0, 6), np.arange(6.0, 11), "less")[1] == pytest.approx(p / 2)
    assert changepoints.rank_test(np.arange(1.0, 6), np.arange(6.0, 11), "greater")[1] > 0.99
    with pytest.raises(ValueError):
        changepoints.rank_test(np.ones(3), np.ones(2))


def test_normal_tail(spark):
    import math

    z = [-6.0, -2.9, -0.5, 0.0, 0.3, 1.0, 2.99, 3.0, 3.01, 5.0, 9.0, 30.0]
    for r in spark.createDataFrame([(v,) for v in z], "z double").select("z", statistics.normal_sf(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-10)


def test_references_are_strand_evidence(spark):
    data = [("A", "+", 0, 10, 1.0), ("B", ".", 4, 15, 1.0), ("C", ".", 10, 20, 1.0), ("D", ".", 15, 25, 1.0), ("E", "-", 20, 30, 1.0), ("R1", "+", 0, 30, 0.0)]
    df = spark.createDataFrame([(1, *r) for r in data], "seqid long, tx string, strand string, start long, end long, expr double")
    got = dict(rows(splice.impute_strands(df, ["seqid", "tx"]), "tx", "strand"))
    assert got == {"A": "+", "B": "+", "C": "+", "D": ".", "E": "-", "R1": "+"}


def test_nearest_of_many_targets_at_one_place(spark):
    rng = np.random.default_rng(4)
    spans = [(int(a), int(a) + int(b)) for a, b in zip(rng.integers(0, 9000, 300), rng.integers(1, 40, 300))] + [(500, 510)] * 50
    t = spark.createDataFrame([("s", a, b, k) for k, (a, b) in enumerate(spans)], "seqid string, start long, end long, k long")
    asked = [int(p) for p in rng.integers(0, 9100, 60)] + [511, 512, 499]
    q = spark.createDataFrame([("s", p, i) for i, p in enumerate(asked)], "seqid string, pos long, q long")
    for side in ("before", "after"):
        got = {}
        for r in intervals.nearest(q, t, side, 3, 700).collect():
            got.setdefault(r["q"], []).append((r["rank"], r["distance"]))
        for i, p in enumerate(asked):
            far = sorted(d for a, b in spans if 0 <= (d := p - 1 - b if side == "before" else a - p - 1) < 700)[:3]
            assert sorted(got.get(i, [])) == [(k + 1, d) for k, d in enumerate(far)]


def test_arrays(spark):
    df = spark.createDataFrame([([5, 20, 29, 32, 32, 32, 63],)], "a array<long>")
    a, x = F.col("a"), F.lit(32).cast("long")
    part = lambda s, e: arrays.padded_slice(a.cast("array<double>"), F.lit(100).cast("long"), F.lit(s).cast("long"), F.lit(e).cast("long"))
    r = df.select(arrays.bisect_left(a, x), arrays.bisect_right(a, x), arrays.between(a, F.lit(20), F.lit(32)), part(98, 102), part(106, 109), part(3, 3)).first()
    assert list(r) == [3, 6, [29, 32, 32, 32], [0, 0, 5, 20], [63, 0, 0], []]
    with pytest.raises(Exception, match="outside"):
        df.select(arrays.checked_slice(a, F.lit(100), F.lit(99), F.lit(101))).collect()
    codes = spark.createDataFrame([("+",), ("-",), (".",)], "s string").select(arrays.strand_code(F.col("s")).alias("c"))
    assert [tuple(r) for r in codes.select("c", arrays.strand_text(F.col("c")), arrays.strand_name(F.col("c"))).collect()] == [(0, "+", "pos"), (1, "-", "neg"), (2, ".", "none")]


def test_bedgraph_and_rejects(spark, tmp_path):
    lines = ["track type=bedGraph", "browser hide", "# x", "tig0001\t0\t5\t1.5", "tig0001\t5\tx\t1", "t 5 9 2"]
    got = rows(text.parse_bedgraph(spark.createDataFrame([(x,) for x in lines], "value string")), "seqid", "start", "end", "value")
    assert got == [("t", 5, 9, 2.0), ("tig0001", 0, 5, 1.5)]
    bad = ["c\ts\texon\tone\t5\t.\t+\t.\tid \"a\"", "c\ts\texon", "c\ts\texon\t1\t5\t.\t+\t.\tid \"a\"", "#c", ""]
    df = spark.createDataFrame([(x,) for x in bad], "value string")
    assert text.parse_gtf(df).count() == 1 and rows(text.gtf_rejects(df), "value") == sorted((x,) for x in bad[:2])
    (tmp_path / "a.gtf").write_text("\n".join(bad))
    gtf.register(spark)
    (r,) = spark.read.format("gtf").load(str(tmp_path / "a.gtf")).collect()
    assert (r["start"], r["end"], r["attrs"]) == (0, 5, {"id": "a"})
    cut = spark.sql("SELECT * FROM split_transfrag(array(0, 30), array(10, 40), array(0, 5, 10, 30, 35, 60))")
    assert rows(cut, "node_start", "node_end") == [(0, 5), (5, 10), (30, 35), (35, 60)]


def lines_of(tx, sample, data):
    out = []
    for name, strand, expr, exons in data:
        head = f'transcript_id "{name}"; FPKM "{expr}";'
        for feature, a, b in [("transcript", exons[0][0], exons[-1][1]), *(("exon", a, b) for a, b in exons)]:
            out.append(f'chr1\tt\t{feature}\t{a + 1}\t{b}\t.\t{strand}\t.\t{head if feature == "transcript" else head.split(";")[0] + ";"}')
    return "\n".join(out)


def test_a_run_from_files_to_outputs(spark, tmp_path):
    a, b, c, d, e = [(i, i + 100) for i in range(0, 1000, 200)]
    (tmp_path / "one.gtf").write_text(lines_of("x", "1", [("p", "+", 10.0, [a, b, c, d, e]), ("q", "+", 5.0, [a, c, e])]))
    (tmp_path / "two.gtf").write_text(lines_of("x", "2", [("p", "+", 2.0, [a, b, c, e]), ("q", ".", 1.0, [a, c, d, e]), ("weak", "+", 0.1, [a, e])]) + "\n" + lines_of("x", "2", [("far", "-", 1000.0, [(20000, 20300)])]))
    (tmp_path / "samples").write_text(f"{tmp_path}/one.gtf\n{tmp_path}/two.gtf\tmine\n")
    manifest = text.read_manifest(spark, f"{tmp_path}/samples")
    assert rows(manifest, "sample_id") == [("1",), ("mine",)]
    run = assembly.Run(spark, f"{tmp_path}/out")
    found = run.run(manifest).orderBy("start", F.desc("expr")).collect()
    # An unrelated locus leaves the gene as it is; the unstranded transfrag joined its strand.
    assert [(r["strand"], round(r["expr"], 6), r["gene_id"], r["transcript_id"]) for r in found] == [("+", 11, "G1", "TU1"), ("+", 6, "G1", "TU2"), ("+", 1, "G1", "TU3"), ("-", 1000, "G2", "TU4")]
    out = lambda name: sorted(r["value"] for r in spark.read.text(f"{tmp_path}/out/{name}").collect())
    third = [x for x in out("assembly.gtf") if "\ttranscript\t" in x and "TU3" in x]
    assert third == ['chr1\tstrandloom\ttranscript\t1\t900\t91\t+\t.\texpr "1.000"; rel_frac "0.09091"; abs_frac "0.05556"; locus_id "L1"; gene_id "G1"; tss_id "TSS1"; transcript_id "TU3";']
    assert "chr1\t99\t201\tJUNC\t12.0\t+\t99\t201\t255,0,0\t2\t1,1\t0,101" in out("splice_junctions.bed") and len(out("transfrags_filtered.gtf")) == 3
    assert any("G1|TU1(11.0)\t1000\t+" in x for x in out("assembly.bed"))
    assert ("+", "chr1\t0\t100\t18.000000") in rows(spark.read.text(f"{tmp_path}/out/bedgraph"), "strand", "value")
    assert any("\tnode\t" in x and 'expr_max "18.0"' in x for x in out("splice_graph.gtf")) and any(x.startswith("chr1\t0\t900\t+\t2\t5\t4\t6\t") for x in out("path_graph_stats.tsv"))
    assert run.status == dict.fromkeys(assembly.STAGES, True)
    again = assembly.Run(spark, f"{tmp_path}/out", resume=True)
    assert again.options == run.options and again.run(manifest).count() == 4
    with pytest.raises(ValueError):
        assembly.Run(spark, f"{tmp_path}/out")
    with pytest.raises(ValueError):
        assembly.Run(spark, f"{tmp_path}/none", resume=True)


def test_ingest_reports_what_is_wrong(spark):
    attrs = lambda i, **k: {"transcript_id": i, **k} if i else k
    data = [("transcript", attrs("a", FPKM="1"), 1), ("exon", attrs("a"), 2), ("transcript", attrs("a", FPKM="1"), 3), ("exon", attrs("z"), 4), ("transcript", attrs("b"), 5), ("CDS", attrs("b"), 6), ("transcript", attrs(None, FPKM="2"), 7)]
    df = spark.createDataFrame([("c", f, 0, 9, "+", a, "s", 0, p, False) for f, a, p in data], "seqid string, feature string, start long, end long, strand string, attrs map<string,string>, sample_id string, block long, place long, is_ref boolean")
    got = sorted((r["feature"], r["tx"], r["problem"]) for r in ingest.aggregated(df, order=["block", "place"]).fillna("", ["tx", "problem"]).collect())
    assert got == [("exon", "", "exon without a transcript"), ("exon", "s.T1", ""), ("transcript", "s.T1", "transcript_id is not unique"), ("transcript", "s.T2", "transcript_id is not unique"), ("transcript", "s.T3", "no expression"), ("transcript", "s.T4", "no transcript_id")]
    with pytest.raises(ValueError):
        ingest.checked(ingest.aggregated(df, order=["block", "place"]))


def test_options_are_checked():
    with pytest.raises(ValueError):
        assembly.Options(isoform_frac=1.5)
    with pytest.raises(ValueError):
        assembly.Options(max_paths=-1)


def test_options_take_effect(spark):
    a, b, c, d, e = [(i, i + 100) for i in range(0, 1000, 200)]
    data = [("p", "+", 10.0, False, [a, b, c, d, e]), ("q", "+", 5.0, False, [a, c, e]), ("r", "+", 0.0, True, [a, d, e])]
    t = spark.createDataFrame([("s", s, x, v, r, [list(p) for p in ex]) for x, s, v, r, ex in data], "seqid string, strand string, tx string, expr double, is_ref boolean, e array<array<long>>")
    t = t.select("*", F.transform("e", lambda p: F.struct(p[0].alias("start"), p[1].alias("end"))).alias("exons")).drop("e")
    t = t.withColumn("start", F.col("exons")[0]["start"]).withColumn("end", F.element_at("exons", -1)["end"]).withColumn("length", F.lit(300))

    def exprs(**options):
        return [round(r["expr"], 3) for r in assembly.assembled(t, assembly.Options(**options)).of("isoform").orderBy(F.desc("expr")).collect()]

    assert exprs() == [10.0, 5.0]
    assert exprs(max_isoforms=1) == [10.0] == exprs(isoform_frac=0.6) == exprs(max_paths=1) == exprs(path_frac=0.6) == exprs(min_expr=6.0)
    assert exprs(min_transfrag_length=301) == []
    assert assembly.assembled(t, assembly.Options(keep_ref=True, guided_assembly=True)).of("k").agg(F.max("transfrags")).first()[0] == 3
    assert assembly.assembled(t, assembly.Options(path_kmax=1)).of("k").agg(F.max("kmax")).first()[0] == 1


def test_rescued_short_paths(spark):
    k = spark.createDataFrame([(1, [1, 2, 3], 6.0), (1, [2, 3, 4], 2.0)], "g long, kmer array<long>, expr double")
    short = spark.createDataFrame([(1, 1, [2, 3], 4.0), (1, 2, [9], 1.0), (1, 3, [1], 2.0)], "g long, id long, path array<long>, expr double")
    gains, lost = splice.rescued(k, short, ["g"], 3)
    assert rows(gains, "kmer", "gain") == [([1, 2, 3], 5.0), ([2, 3, 4], 1.0)] and rows(lost, "id") == [(2,)]


def test_locus_index_and_one_locus_again(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 10, 50), ("chr1", 50, 100), ("chr1", 99, 200), ("chr2", 100, 200)], "seqid string, start long, end long")
    index = intervals.loci(df)
    text.write_lines(index.select(text.locus_line().alias("value")), f"{tmp_path}/index")
    again = text.read_locus_index(spark, f"{tmp_path}/index")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index.collect()))
    intervals.write_located(intervals.located(df, again, ["locus_id"]), f"{tmp_path}/located", buckets=4)
    one = intervals.read_locus(spark, f"{tmp_path}/located", "L2", buckets=4)
    assert rows(one, "start", "end") == [(50, 100), (99, 200)]


def test_levels_of_many_graphs(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3), (2, 5, 6), (2, 6, 5), (2, 4, 5)], "g long, src long, dst long")
    got = graphs.levels_within(edges, "g").collect()
    assert sorted((r["g"], r["node"], -1 if r["level"] is None else r["level"]) for r in got) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 4, 0), (2, 5, -1), (2, 6, -1)]
    order = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (9, 3)], "node long, pos long")
    assert not graphs.is_topological(order, edges.where("g = 1"))


def test_streamed_features(spark, tmp_path):
    from strandloom.streaming.features import stream_gtf

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gtf").write_text('c\ts\texon\t1\t5\t.\t+\t.\tid "a"\n#x\n')
    q = stream_gtf(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("features").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("features"), "start", "end") == [(0, 5)]


def test_entry_works():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
