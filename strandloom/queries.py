"""Registered queries of the interval engine over the driver's tables, and their SQL.

The tables hold no annotation, so views give them its shape: ``exons`` reads lineitem's rows as
intervals of days on parts, ``parts of transcripts`` merges them by part and supplier group, and
``signal`` reads events in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .durable import cut
from .functions import arrays
from .operators import coverage, graphs, intervals, signals, splice, statistics, transcripts
from .plans import assembly
from .shipping import ship
from .sources import ingest, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EXONS = """exons AS (
  SELECT l_partkey AS seqid, l_orderkey AS tx,
         CASE WHEN l_returnflag = 'N' THEN '.' WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS start,
         CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) AS "end",
         l_quantity AS expr, l_suppkey AS supp
  FROM lineitem)"""
TX = EXONS + """, t0 AS (
  SELECT seqid, seqid * 8 + supp % 8 AS tx, start, "end", expr,
         max("end") OVER (PARTITION BY seqid, supp % 8 ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM exons), t1 AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY tx ORDER BY start, "end", reach NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM t0), tx_exons AS (
  SELECT seqid, tx, CASE tx % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand, min(start) AS start, max("end") AS "end", sum(expr) AS expr
  FROM t1 GROUP BY seqid, tx, island)"""
SIGNAL = """signal AS (
  SELECT event_type AS key, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS pos, value FROM events)"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.datediff("l_shipdate", F.lit("1995-01-01")).cast("long")
    strand = F.when(F.col("l_returnflag") == "N", ".").when(F.col("l_linestatus") == "F", "+").otherwise("-")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("seqid"), F.col("l_orderkey").alias("tx"), strand.alias("strand"), start.alias("start"),
        (start + F.col("l_quantity").cast("long")).alias("end"), F.col("l_quantity").alias("expr"), F.col("l_suppkey").alias("supp"),
    )


def tx_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = exons(spark, sf_dir).withColumn("tx", F.col("seqid") * 8 + F.col("supp") % 8)
    merged = intervals.merge_islands(raw, ["seqid", "tx"], closed=True, sums={"expr": F.col("expr")})
    m = F.col("tx") % 3
    return merged.select("seqid", "tx", F.when(m == 0, "+").when(m == 1, "-").otherwise(".").alias("strand"), "start", "end", "expr")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("block", F.floor(F.col("event_id") / 4096))
    rows = ingest.numbered_in(rows, ["event_type"], "block", ["event_id"], "n")
    return rows.select(F.col("event_type").alias("key"), (F.col("n") - 1).cast("long").alias("pos"), "value")


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"""WITH {EXONS}, a AS (SELECT *, max("end") OVER (PARTITION BY seqid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY start, "end", reach NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM a),
c AS (SELECT seqid, min(start) AS start, max("end") AS "end", count(*) AS n_features FROM b GROUP BY seqid, island)
SELECT 'L' || row_number() OVER (ORDER BY seqid, start) AS locus_id, seqid, start, "end", n_features FROM c""")
def locus_index(spark, d):
    return intervals.loci(exons(spark, d))


@query(f"""WITH {EXONS}, a AS (SELECT *, max("end") OVER (PARTITION BY seqid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY start, "end", reach NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT seqid, min(start) AS start, max("end") AS "end", count(*) AS n FROM b GROUP BY seqid, island HAVING count(*) >= 2""")
def interval_clusters_gap(spark, d):
    return intervals.clusters(exons(spark, d), ["seqid"], 5, 2)


@query(f"""WITH {EXONS}, a AS (SELECT *, max("end") OVER (PARTITION BY seqid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY start, "end", reach NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM a),
c AS (SELECT seqid, island, min(start) AS cluster FROM b GROUP BY seqid, island HAVING count(*) >= 2)
SELECT seqid, cluster, tx, start, "end", count(*) AS n FROM b JOIN c USING (seqid, island) GROUP BY ALL""")
def cluster_members(spark, d):
    e = exons(spark, d).select("seqid", "tx", "start", "end")
    spans = cut(intervals.clusters(e, ["seqid"], 5, 2).withColumn("cluster", F.col("start")), "clusters")
    return intervals.located(e, spans, ["cluster"]).groupBy("seqid", "cluster", "tx", "start", "end").agg(F.count(F.lit(1)).alias("n"))


_RUNS = """e AS (SELECT seqid, strand, start AS pos, expr AS d FROM exons UNION ALL SELECT seqid, strand, "end", -expr FROM exons),
s AS (SELECT seqid, strand, pos, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0),
l AS (SELECT seqid, strand, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS value FROM s WINDOW w AS (PARTITION BY seqid, strand ORDER BY pos)),
runs AS (SELECT seqid, strand, start, "end", value FROM l WHERE "end" IS NOT NULL AND value <> 0)"""


@query(f"WITH {EXONS}, {_RUNS} SELECT seqid, strand, start, \"end\", value FROM runs")
def coverage_bedgraph(spark, d):
    return coverage.runs(exons(spark, d), ["seqid", "strand"]).select("seqid", "strand", "start", "end", "value")


@query(f"WITH {EXONS}, {_RUNS} SELECT seqid, strand, CAST(sum((\"end\" - start) * value) AS DOUBLE) AS area, max(value) AS peak FROM runs GROUP BY seqid, strand")
def coverage_from_bedgraph(spark, d):
    level = coverage.runs(exons(spark, d), ["seqid", "strand"])
    named = level.withColumn("seqid", F.concat_ws(" ", "seqid", "strand"))
    lines = named.select(F.translate(text.bedgraph_line(), " ", "/").alias("value")).unionByName(spark.createDataFrame([("track type=bedGraph",), ("# comment",), ("broken line",)], "value string"))
    again = coverage.runs(text.parse_bedgraph(lines), ["seqid"], "value")
    at = F.split("seqid", "/")
    again = again.select(at[0].cast("long").alias("seqid"), at[1].alias("strand"), "start", "end", "value")
    return again.groupBy("seqid", "strand").agg(F.sum((F.col("end") - F.col("start")) * F.col("value")).alias("area"), F.max("value").alias("peak"))


_FRACTION = """fx AS (SELECT l_partkey AS seqid, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS start,
CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) AS "end", l_extendedprice * l_discount AS v FROM lineitem WHERE l_extendedprice * l_discount <> 0),
fe AS (SELECT seqid, start AS pos, v AS d, 1 AS n FROM fx UNION ALL SELECT seqid, "end", -v, -1 FROM fx), fs AS (SELECT seqid, pos, sum(d) AS d, sum(abs(d)) AS a, sum(n) AS n FROM fe GROUP BY ALL),
fl AS (SELECT seqid, pos, d, a, n, sum(n) OVER w AS upon, sum(d) OVER w AS value FROM fs WINDOW w AS (PARTITION BY seqid ORDER BY pos)),
fk AS (SELECT seqid, pos AS start, lead(pos) OVER (PARTITION BY seqid ORDER BY pos) AS "end", upon, value FROM fl WHERE abs(d) > 1e-9 * a OR (upon = 0) <> (upon = n))"""


@query(f"WITH {_FRACTION} SELECT seqid, start, \"end\", round(value, 4) AS value FROM fk WHERE upon > 0 AND \"end\" IS NOT NULL")
def coverage_fractions(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_partkey").alias("seqid"), F.datediff("l_shipdate", F.lit("1995-01-01")).cast("long").alias("start"), "l_quantity", (F.col("l_extendedprice") * F.col("l_discount")).alias("expr"))
    rows = rows.withColumn("end", F.col("start") + F.col("l_quantity").cast("long"))
    return coverage.runs(rows, ["seqid"]).select("seqid", "start", "end", F.round("value", 4).alias("value"))


@query(f"""WITH {EXONS}, {_RUNS}, z AS (SELECT seqid, strand, start, value FROM runs UNION ALL
SELECT seqid, strand, "end", 0 FROM (SELECT *, lead(start) OVER (PARTITION BY seqid, strand ORDER BY start) AS nxt FROM runs) WHERE nxt > "end"),
c AS (SELECT seqid, strand, start AS pos, value > 40 AS high, lag(value) OVER (PARTITION BY seqid, strand ORDER BY start) > 40 AS was FROM z)
SELECT seqid, strand, pos FROM c WHERE was <> high""")
def threshold_points(spark, d):
    return coverage.threshold_points(coverage.runs(exons(spark, d), ["seqid", "strand"]), ["seqid", "strand"], 40)


@query(f"""WITH {EXONS} SELECT a.seqid, a.tx, a.start, a."end", b.tx AS r_tx, b.start AS r_start, b."end" AS r_end, count(*) AS n
FROM exons a JOIN exons b ON a.seqid = b.seqid AND a.start < b."end" AND b.start < a."end" WHERE a.strand = '+' AND b.strand = '-' GROUP BY ALL""")
def interval_overlap_join(spark, d):
    e = exons(spark, d).select("seqid", "tx", "strand", "start", "end")
    hits = intervals.overlap_join(e.where("strand = '+'").drop("strand"), e.where("strand = '-'").drop("strand"), size=64)
    return hits.groupBy("seqid", "tx", "start", "end", "r_tx", "r_start", "r_end").agg(F.count(F.lit(1)).alias("n"))


def _near(side: str) -> str:
    edge, dist = ('b."end"', 'a.start - 1 - b."end"') if side == "before" else ("b.start", "b.start - (a.start + 1)")
    return f"""WITH {EXONS}, q AS (SELECT DISTINCT seqid, start FROM exons WHERE strand = '+'), r AS (
SELECT a.seqid, a.start AS pos, {dist} AS distance FROM q a JOIN exons b ON a.seqid = b.seqid AND {dist} >= 0 AND {dist} < 2500),
k AS (SELECT *, row_number() OVER (PARTITION BY seqid, pos ORDER BY distance) AS rank FROM r)
SELECT seqid, pos, distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3"""


def _nearest(spark, d, side):
    e = exons(spark, d)
    q = e.where("strand = '+'").select("seqid", F.col("start").alias("pos")).distinct().withColumn("q", F.struct("seqid", "pos"))
    return intervals.nearest(q, e.select("seqid", "start", "end"), side, 3, 2500).select("seqid", "pos", "distance", "rank")


@query(_near("before"))
def nearest_before(spark, d):
    return _nearest(spark, d, "before")


@query(_near("after"))
def nearest_after(spark, d):
    return _nearest(spark, d, "after")


@query(f"""WITH {TX} SELECT seqid, tx, strand, min(start) AS start, max("end") AS "end", CAST(sum("end" - start) AS BIGINT) AS length, sum(expr) AS expr,
CASE WHEN strand = '-' THEN max("end") ELSE min(start) END AS tss, CASE WHEN strand = '-' THEN min(start) ELSE max("end") END AS stop
FROM tx_exons GROUP BY seqid, tx, strand HAVING sum("end" - start) >= 100 AND sum(expr) >= 120""")
def transfrag_filter(spark, d):
    kept, _ = transcripts.filtered(transcripts.transfrags(tx_exons(spark, d), ["seqid", "tx", "strand"]), 100, 120)
    return kept.withColumn("tss", transcripts.tss()).withColumn("stop", transcripts.stop()).drop("exons")


@query(f"""WITH {TX} SELECT seqid, tx, CAST(sum("end" - start) AS BIGINT) AS length, sum(expr) AS expr FROM tx_exons GROUP BY seqid, tx HAVING NOT (sum("end" - start) >= 100 AND sum(expr) >= 120)""")
def transfrag_rejects(spark, d):
    _, rejects = transcripts.filtered(transcripts.transfrags(tx_exons(spark, d), ["seqid", "tx"]), 100, 120)
    return rejects.select("seqid", "tx", "length", "expr")


@query(f"""WITH {TX}, g AS (SELECT seqid, tx, sum(expr) AS expr FROM tx_exons GROUP BY ALL), f AS (SELECT *, expr / max(expr) OVER (PARTITION BY seqid) AS frac FROM g)
SELECT x.seqid, x.tx, x.start, x."end" FROM tx_exons x WHERE tx IN (SELECT tx FROM f WHERE frac >= 0.8)""")
def semi_join_post_filter(spark, d):
    x = tx_exons(spark, d)
    g = transcripts.fractions(x.groupBy("seqid", "tx").agg(F.sum("expr").alias("expr")), "seqid")
    return x.join(g.where("rel_frac >= 0.8").select("tx"), "tx", "left_semi").select("seqid", "tx", "start", "end")


@query(f"""WITH {TX}, i AS (SELECT seqid, tx, strand, expr, "end" AS start, lead(start) OVER (PARTITION BY tx ORDER BY start) AS "end" FROM tx_exons)
SELECT seqid, tx, start, "end" FROM i WHERE "end" IS NOT NULL""")
def introns(spark, d):
    return coverage.introns(tx_exons(spark, d), ["seqid", "tx"]).select("seqid", "tx", "start", "end")


@query(f"""WITH {TX}, i AS (SELECT seqid, strand, expr, "end" AS s, lead(start) OVER (PARTITION BY tx ORDER BY start) AS e FROM tx_exons)
SELECT seqid, s - 1 AS bed_start, e + 1 AS bed_end, strand, sum(expr) AS expr, '0,' || (e - s + 1) AS block_starts FROM i WHERE e IS NOT NULL AND strand <> '.' GROUP BY seqid, s, e, strand""")
def splice_junction_bed(spark, d):
    return coverage.junctions(tx_exons(spark, d), ["seqid", "tx"])


@query(f"""WITH {EXONS} SELECT seqid, min(start) AS start, max("end") AS "end", string_agg(DISTINCT strand, '' ORDER BY strand) AS strands FROM exons GROUP BY seqid""")
def locus_bounds(spark, d):
    return intervals.bounds(exons(spark, d), ["seqid"]).withColumn("strands", F.array_join("strands", ""))


_PLAIN = """p AS (SELECT seqid, start AS pos, 1 AS d FROM tx_exons UNION ALL SELECT seqid, "end", -1 FROM tx_exons), ps AS (SELECT seqid, pos, sum(d) AS d FROM p GROUP BY ALL),
pl AS (SELECT seqid, pos, sum(d) OVER w AS v, coalesce(sum(d) OVER w2, 0) AS was FROM ps WINDOW w AS (PARTITION BY seqid ORDER BY pos), w2 AS (PARTITION BY seqid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_BOUNDS = f"""{_PLAIN}, bi AS (SELECT seqid, "end" AS s, lead(start) OVER (PARTITION BY tx ORDER BY start) AS e FROM tx_exons),
bounds AS (SELECT seqid, s AS pos FROM bi WHERE e IS NOT NULL UNION SELECT seqid, e FROM bi WHERE e IS NOT NULL
UNION SELECT seqid, pos FROM pl WHERE (v = 0) <> (was = 0) UNION SELECT seqid, min(start) FROM tx_exons GROUP BY seqid UNION SELECT seqid, max("end") FROM tx_exons GROUP BY seqid)"""
_NODES = f"{_BOUNDS}, nodes AS (SELECT seqid, pos AS start, lead(pos) OVER (PARTITION BY seqid ORDER BY pos) AS \"end\" FROM bounds)"


@query(f"WITH {TX}, {_BOUNDS} SELECT seqid, pos FROM bounds")
def node_boundaries(spark, d):
    return splice.boundaries(tx_exons(spark, d), ["seqid", "tx"])


_HITS = """hits AS (SELECT x.seqid, x.tx, x.expr, n.start AS node_start, n."end" AS node_end FROM tx_exons x JOIN nodes n ON n.seqid = x.seqid AND n.start < x."end" AND x.start < n."end" WHERE n."end" IS NOT NULL)"""


@query(f"WITH {TX}, {_NODES}, {_HITS} SELECT seqid, tx, node_start, node_end FROM hits")
def split_transfrags(spark, d):
    x = tx_exons(spark, d)
    return splice.split_transfrags(x, splice.nodes(splice.boundaries(x, ["seqid", "tx"]))).select("seqid", "tx", "node_start", "node_end")


def _hits(spark, d):
    return splice.on_nodes(tx_exons(spark, d), ["seqid", "tx"])


def _edges(spark, d):
    h = _hits(spark, d).select("tx", "node_start", (F.col("seqid") * 100000 + F.col("node_start")).alias("node"))
    return graphs.path_edges(h, ["tx"], "node_start", "node")


_EDGES = "en AS (SELECT tx, node_start, seqid * 100000 + node_start AS node FROM hits), ee AS (SELECT node AS src, lead(node) OVER (PARTITION BY tx ORDER BY node_start) AS dst FROM en), edges AS (SELECT DISTINCT src, dst FROM ee WHERE dst IS NOT NULL)"


@query(f"WITH {TX}, {_NODES}, {_HITS}, {_EDGES} SELECT src, dst FROM edges")
def splice_graph_edges(spark, d):
    return _edges(spark, d)


@query(f"""WITH {TX}, {_NODES}, {_HITS}, {_EDGES} SELECT DISTINCT node, node NOT IN (SELECT dst FROM edges) AS is_start, node NOT IN (SELECT src FROM edges) AS is_stop FROM en""")
def start_stop_nodes(spark, d):
    h = _hits(spark, d).select((F.col("seqid") * 100000 + F.col("node_start")).alias("node"))
    return graphs.leaf_nodes(h, _edges(spark, d))


@query(f"""WITH {TX}, {_NODES}, c AS (SELECT n.seqid, n.start, n."end", x.expr, greatest(n.start, x.start) AS a, least(n."end", x."end") AS b FROM nodes n JOIN tx_exons x ON n.seqid = x.seqid AND n.start < x."end" AND x.start < n."end" WHERE n."end" IS NOT NULL)
SELECT c.seqid, c.start, c."end", round(sum((b - a) * expr) / (c."end" - c.start), 4) AS mean, any_value(m.low) AS low, any_value(m.high) AS high
FROM c JOIN (SELECT n.seqid, n.start, min(r.value) AS low, max(r.value) AS high FROM nodes n JOIN rz r ON r.seqid = n.seqid AND r.start < n."end" AND n.start < r."end" WHERE n."end" IS NOT NULL GROUP BY ALL) m ON m.seqid = c.seqid AND m.start = c.start GROUP BY c.seqid, c.start, c."end" """.replace("c AS (", """re AS (SELECT seqid, start AS pos, expr AS d FROM tx_exons UNION ALL SELECT seqid, "end", -expr FROM tx_exons), rs AS (SELECT seqid, pos, sum(d) AS d FROM re GROUP BY ALL),
rz AS (SELECT seqid, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS value FROM rs WINDOW w AS (PARTITION BY seqid ORDER BY pos)), c AS (""", 1))
def node_stats(spark, d):
    x = tx_exons(spark, d)
    n = splice.nodes(splice.boundaries(x, ["seqid", "tx"]))
    return coverage.node_statistics(n, coverage.runs(x, ["seqid"])).select("seqid", "start", "end", F.round("mean", 4).alias("mean"), "low", "high")


def _splice_edges(spark, d):
    """Edges of all splice graphs, with the sequence they are of."""
    return cut(_edges(spark, d).withColumn("seqid", F.floor(F.col("src") / 100000)), "edges")


@query(f"""WITH RECURSIVE {TX}, {_NODES}, {_HITS}, {_EDGES}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r(node, reach) AS (SELECT src, src FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def weak_components(spark, d):
    return graphs.components(_edges(spark, d))


@query(f"""WITH RECURSIVE {TX}, {_NODES}, {_HITS}, {_EDGES}, r(node, hops) AS (SELECT DISTINCT src, 0 FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, r.hops + 1 FROM r JOIN edges e ON e.src = r.node)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node""")
def reachable_nodes(spark, d):
    e = _splice_edges(spark, d)
    starts = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    return graphs.reachable(e, starts)


@query(f"""WITH RECURSIVE {TX}, {_NODES}, {_HITS}, {_EDGES}, r(node, level) AS (SELECT DISTINCT src, 0 FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, r.level + 1 FROM r JOIN edges e ON e.src = r.node)
SELECT node // 100000 AS seqid, node, CAST(max(level) AS INTEGER) AS level FROM r GROUP BY node""")
def toposort_levels(spark, d):
    return graphs.levels_within(_splice_edges(spark, d), "seqid")


@query(f"""WITH {TX}, {_NODES}, {_HITS}, {_EDGES} SELECT src, dst FROM edges WHERE src % 100000 % 7 <> 0 AND dst % 100000 % 7 <> 0""")
def removed_nodes(spark, d):
    e = _edges(spark, d)
    n = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return graphs.without(n, e, n.where("node % 100000 % 7 = 0"))[1]


@query("""WITH v AS (SELECT event_type AS key, list_sort(list(value)) AS v FROM events WHERE value BETWEEN 1 AND 1000000 GROUP BY event_type)
SELECT key, round(v[floor(0.9 * (len(v) - 1))::INT + 1] + (0.9 * (len(v) - 1) - floor(0.9 * (len(v) - 1))) * (v[ceil(0.9 * (len(v) - 1))::INT + 1] - v[floor(0.9 * (len(v) - 1))::INT + 1]), 6) AS fraction,
v[floor(0.9 * (len(v) - 1))::INT + 1] AS lower, v[ceil(0.9 * (len(v) - 1))::INT + 1] AS higher FROM v""")
def percentile_scores(spark, d):
    rows = _table(spark, d, "events").select(F.col("event_type").alias("key"), "value")
    return statistics.percentile(rows, ["key"], "value", 90, (1.0, 1e6)).withColumn("fraction", F.round("fraction", 6))


@query("""SELECT l_suppkey AS key, l_quantity AS value, CAST(rank() OVER w AS INTEGER) AS rank_min, CAST(dense_rank() OVER w AS INTEGER) AS rank_dense,
CAST(row_number() OVER w AS INTEGER) AS rank_ordinal, CAST(rank() OVER w + count(*) OVER s - 1 AS INTEGER) AS rank_max, rank() OVER w + (count(*) OVER s - 1) / 2.0::DOUBLE AS rank_average
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity), s AS (PARTITION BY l_suppkey, l_quantity)""")
def rankdata_all(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("value"))
    return statistics.ranks(rows, ["key"], "value")


@query("""WITH c AS (SELECT l_suppkey AS key, l_quantity, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY ALL)
SELECT key, round(CASE WHEN sum(c) < 2 THEN 1.0 ELSE 1.0 - sum(c * c * c - c) / (sum(c) * sum(c) * sum(c) - sum(c)) END, 9) AS correction FROM c GROUP BY key""")
def tiecorrect(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("value"))
    return statistics.tie_correction(rows, ["key"], "value").select("key", F.round("correction", 9).alias("correction"))


@query("""WITH r AS (SELECT l_suppkey AS key, l_returnflag = 'N' AS x, rank() OVER w + (count(*) OVER s - 1) / 2.0 AS r FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity), s AS (PARTITION BY l_suppkey, l_quantity))
SELECT key, CAST(count(*) FILTER (x) * count(*) FILTER (NOT x) - (count(*) FILTER (x) * count(*) FILTER (NOT x) + count(*) FILTER (x) * (count(*) FILTER (x) + 1) / 2.0 - sum(r) FILTER (x)) AS DOUBLE) AS u2 FROM r GROUP BY key""")
def mannwhitney_u(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.when(F.col("l_returnflag") == "N", "x").otherwise("y").alias("side"), F.col("l_quantity").alias("value"))
    return statistics.mann_whitney(rows, ["key"], "side", "value").select("key", "u2")


# The tail of the normal distribution by Simpson's rule.
_SIMPSON = "0.5 - z / 600 / sqrt(2 * pi()) / 3 * list_sum(list_transform(range(0, 601), lambda i: (CASE WHEN i IN (0, 600) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(z * i / 600) * (z * i / 600) / 2)))"


@query(f"""WITH r AS (SELECT l_suppkey AS key, l_returnflag = 'N' AS x, l_quantity AS q, rank() OVER w + (count(*) OVER s - 1) / 2.0 AS r FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_quantity), s AS (PARTITION BY l_suppkey, l_quantity)),
t AS (SELECT key, sum(c * c * c - c) AS ties FROM (SELECT key, q, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY ALL) GROUP BY key),
u AS (SELECT key, CAST(count(*) FILTER (x) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT x) AS DOUBLE) AS n2, sum(r) FILTER (x) AS r1 FROM r GROUP BY key),
v AS (SELECT key, n1, n2, n1 * n2 + n1 * (n1 + 1) / 2 - r1 AS u1, sqrt((1 - ties / ((n1 + n2) ** 3 - (n1 + n2))) * n1 * n2 * (n1 + n2 + 1) / 12) AS sd FROM u JOIN t USING (key)),
w AS (SELECT key, n1 * n2 - u1 AS u2, abs(greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sd AS z FROM v)
SELECT key, u2, round(z, 9) AS z, round(2 * ({_SIMPSON}), 8) AS p FROM w""")
def mannwhitney_p(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.when(F.col("l_returnflag") == "N", "x").otherwise("y").alias("side"), F.col("l_quantity").alias("value"))
    return statistics.mann_whitney(rows, ["key"], "side", "value").select("key", "u2", F.round("z", 9).alias("z"), F.round("p", 8).alias("p"))


_WEIGHTS = signals.window_weights("hanning", 11)
_SMOOTH = " + ".join(f"{w!r} * p[abs({s} + CAST(i AS INT)) - 2 * greatest(0, {s} + CAST(i AS INT) - (n - 1)) + 1]" for w, s in zip(_WEIGHTS, range(-5, 6)))


@query(f"""WITH {SIGNAL}, a AS (SELECT key, list(value ORDER BY pos) AS p, CAST(count(*) AS INT) AS n FROM signal GROUP BY key HAVING count(*) >= 11), u AS (SELECT key, p, n, unnest(range(n)) AS i FROM a)
SELECT key, i AS pos, round({_SMOOTH}, 3) AS smoothed FROM u""")
def smooth_signal(spark, d):
    return signals.smooth(signal(spark, d), ["key"]).select("key", "pos", F.round("smoothed", 3).alias("smoothed"))


@query(f"""WITH {SIGNAL}, g AS (SELECT key, pos, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM signal WINDOW w AS (PARTITION BY key ORDER BY pos))
SELECT key, pos, round(CASE WHEN b IS NULL THEN a - value WHEN a IS NULL THEN value - b ELSE (a - b) / 2 END, 6) AS gradient FROM g""")
def gradient_signal(spark, d):
    return signals.gradient(signal(spark, d), ["key"]).select("key", "pos", F.round("gradient", 6).alias("gradient"))


_SQ = "signal AS (SELECT l_suppkey AS key, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS pos, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def _daily(spark, d):
    e = exons(spark, d)
    return e.groupBy(F.col("supp").alias("key"), F.col("start").alias("pos")).agg(F.sum("expr").alias("value"))


@query(f"""WITH {_SQ}, g AS (SELECT key, pos, value, row_number() OVER w - 1 AS i, count(*) OVER e AS n, sum(value) OVER b AS s, sum(value * value) OVER b AS q, sum(value) OVER e AS ts, sum(value * value) OVER e AS tq, lag(value) OVER w AS was FROM signal
WINDOW w AS (PARTITION BY key ORDER BY pos), e AS (PARTITION BY key), b AS (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT key, i, round((q - s * s / i) + ((tq - q) - (ts - s) * (ts - s) / (n - i)), 6) AS sse FROM g WHERE i > 0 AND was <> value)
SELECT key, CAST(coalesce(arg_min(i, (sse, i)), -1) AS INTEGER) AS split FROM h GROUP BY key""")
def mse_split(spark, d):
    return signals.mse_split(_daily(spark, d), ["key"])


@query(f"""WITH {_SQ}, g AS (SELECT key, pos, CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE lead(value) OVER w - lag(value) OVER w END AS s FROM signal WINDOW w AS (PARTITION BY key ORDER BY pos)),
h AS (SELECT key, pos, CAST(sign(s) AS INTEGER) AS sign FROM g), k AS (SELECT *, CASE WHEN lag(sign) OVER (PARTITION BY key ORDER BY pos) = sign THEN 0 ELSE 1 END AS fresh FROM h), m AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY pos) AS run FROM k)
SELECT key, pos, sign, CAST(CASE WHEN sign = 0 THEN 0 ELSE row_number() OVER (PARTITION BY key, run ORDER BY pos) END AS INTEGER) AS dist_left,
CAST(CASE WHEN sign = 0 THEN 0 ELSE row_number() OVER (PARTITION BY key, run ORDER BY pos DESC) END AS INTEGER) AS dist_right FROM m""")
def slope_extract(spark, d):
    return signals.slope_runs(_daily(spark, d), ["key"]).withColumn("sign", F.col("sign").cast("int"))


@query(f"""WITH {_SQ}, m AS (SELECT key, pos, value - avg(value) OVER (PARTITION BY key) AS v FROM signal), c AS (SELECT key, pos, round(sum(v) OVER (PARTITION BY key ORDER BY pos), 4) AS s FROM m)
SELECT key, round(max(s) - min(s), 2) AS range, min(pos) AS first_pos, arg_max(pos, (abs(s), -pos)) AS peak_pos FROM c GROUP BY key""")
def cusum(spark, d):
    return signals.cusum(_daily(spark, d), ["key"]).select("key", "range", "first_pos", "peak_pos")


_PATHS = "paths AS (SELECT seqid, tx, list(seqid * 100000 + node_start ORDER BY node_start) AS path, any_value(tx) % 7 + 1 AS expr FROM hits GROUP BY seqid, tx)"


def _paths(spark, d):
    h = _hits(spark, d).withColumn("node", F.col("seqid") * 100000 + F.col("node_start"))
    return h.groupBy("seqid", "tx").agg(F.array_sort(F.collect_set("node")).alias("path")).withColumn("expr", F.col("tx") % 7 + 1)


@query(f"""WITH {TX}, {_NODES}, {_HITS}, {_PATHS}, k AS (SELECT seqid, len(path) AS n, path, expr, unnest(range(greatest(len(path) - 1, 0))) AS i FROM paths)
SELECT path[i + 1] || '-' || path[i + 2] AS kmer, CAST(sum(expr) AS BIGINT) AS expr, CAST(sum(CASE WHEN i = 0 THEN expr ELSE 0 END) AS BIGINT) AS smooth_rev, CAST(sum(CASE WHEN i = n - 2 THEN expr ELSE 0 END) AS BIGINT) AS smooth_fwd FROM k GROUP BY 1""")
def kmer_expr(spark, d):
    rows = splice.kmers(_paths(spark, d), 2).withColumn("kmer", F.array_join(F.col("kmer").cast("array<string>"), "-"))
    return splice.kmer_expression(rows, [])


@query(f"""WITH {TX}, {_NODES}, {_HITS}, {_PATHS}, k AS (SELECT seqid, tx, path, unnest(range(greatest(len(path) - 2, 0))) AS i FROM paths)
SELECT seqid, tx, CAST(i AS INTEGER) AS at, concat_ws('-', path[i + 1], path[i + 2], path[i + 3]) AS kmer FROM k""")
def kmer_table(spark, d):
    return splice.kmers(_paths(spark, d), 3).select("seqid", "tx", "at", F.array_join(F.col("kmer").cast("array<string>"), "-").alias("kmer"))


@query(f"""WITH {TX}, {_NODES}, {_HITS}, {_PATHS}, ke AS (SELECT seqid, [path[i + 1], path[i + 2], path[i + 3]] AS kmer, sum(expr) AS expr FROM (SELECT seqid, path, expr, unnest(range(greatest(len(path) - 2, 0))) AS i FROM paths) GROUP BY ALL),
parts AS (SELECT DISTINCT seqid, kmer, expr, part FROM (SELECT seqid, kmer, expr, unnest([[kmer[1]], [kmer[2]], [kmer[3]], [kmer[1], kmer[2]], [kmer[2], kmer[3]]]) AS part FROM ke)),
short AS (SELECT seqid, tx, path, expr FROM paths WHERE len(path) < 3), hit AS (SELECT s.seqid, s.tx, p.kmer, s.expr * p.expr / sum(p.expr) OVER (PARTITION BY s.seqid, s.tx) AS gain FROM short s JOIN parts p ON p.seqid = s.seqid AND p.part = s.path)
SELECT seqid, array_to_string(kmer, '-') AS kmer, round(sum(gain), 8) AS gain FROM hit GROUP BY ALL""")
def short_path_rescue(spark, d):
    p = cut(_paths(spark, d), "paths")
    known = splice.kmer_expression(splice.kmers(p, 3), ["seqid"])
    short = p.where(F.size("path") < 3).withColumnRenamed("tx", "id")
    gains, _ = splice.rescued(known, short, ["seqid"], 3)
    return gains.select("seqid", F.array_join(F.col("kmer").cast("array<string>"), "-").alias("kmer"), F.round("gain", 8).alias("gain"))


@query(f"""WITH {TX}, {_NODES}, {_HITS}, rn AS (SELECT seqid, tx, node_start, node_end, CASE WHEN lag(node_end) OVER w = node_start THEN 0 ELSE 1 END AS fresh FROM hits WINDOW w AS (PARTITION BY tx ORDER BY node_start)),
ri AS (SELECT *, sum(fresh) OVER (PARTITION BY tx ORDER BY node_start) AS island FROM rn) SELECT seqid, tx, min(node_start) AS start, max(node_end) AS "end" FROM ri GROUP BY seqid, tx, island""")
def reconstruct_exons(spark, d):
    h = _hits(spark, d).select("seqid", "tx", F.col("node_start").alias("start"), F.col("node_end").alias("end"))
    return splice.reconstructed(h, ["seqid", "tx"])


@query(f"""WITH RECURSIVE {TX}, x AS (SELECT DISTINCT tx, seqid * 1000000 + start * 64 + least("end" - start, 63) AS e FROM tx_exons), p AS (SELECT a.tx AS src, b.tx AS dst FROM x a JOIN x b ON a.e = b.e),
r(tx, reach) AS (SELECT src, dst FROM p UNION SELECT r.tx, p.dst FROM r JOIN p ON p.src = r.reach) SELECT tx, min(reach) AS gene FROM r GROUP BY tx""")
def gene_clusters(spark, d):
    x = tx_exons(spark, d).select((2 * F.col("tx")).alias("src"), (2 * (F.col("seqid") * 1000000 + F.col("start") * 64 + F.least(F.col("end") - F.col("start"), F.lit(63))) + 1).alias("dst"))
    found = graphs.components(x).where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("tx"), "component")
    return found.withColumn("gene", F.min("tx").over(Window.partitionBy("component"))).drop("component")


@query(f"WITH {TX}, {_NODES}, {_HITS}, {_PATHS} SELECT seqid, max(len(path)) AS longest FROM paths GROUP BY seqid")
def longest_path(spark, d):
    return _paths(spark, d).groupBy("seqid").agg(F.max(F.size("path")).cast("long").alias("longest"))


@query(f"""WITH {EXONS}, l AS (SELECT DISTINCT 'chr' || seqid AS seqid, start, "end", strand, tx FROM exons) SELECT seqid, 'exon' AS feature, start, "end", strand, CAST(tx AS VARCHAR) AS transcript_id FROM l""")
def gtf_roundtrip(spark, d):
    e = exons(spark, d).select(F.concat(F.lit("chr"), "seqid").alias("seqid"), F.lit("exon").alias("feature"), "start", "end", F.lit("0").alias("score"), "strand", "tx").distinct()
    lines = e.select(text.gtf_line([("transcript_id", F.col("tx")), ("ref", F.lit("0"))]).alias("value"))
    return text.parse_gtf(lines).select("seqid", "feature", "start", "end", "strand", F.col("attrs")["transcript_id"].alias("transcript_id"))


def _sample_features(spark, d):
    """Orders as transcripts of 20 samples and a reference, their lines as exons; a line's order may be missing."""
    o, x = _table(spark, d, "orders"), _table(spark, d, "lineitem")
    sample = lambda c: F.when(F.pmod(c, F.lit(21)) == 20, ingest.REFERENCE).otherwise(F.pmod(c, F.lit(21)).cast("string"))
    columns = ["seqid", "feature", "start", "end", "strand", "attrs", "sample_id", "block", "place"]
    key = lambda c: F.col(c)
    heads = o.where("o_orderkey % 11 <> 0").select(
        F.lit("c").alias("seqid"), F.lit("transcript").alias("feature"), F.lit(0).cast("long").alias("start"), F.lit(9).cast("long").alias("end"), F.lit("+").alias("strand"),
        F.create_map(F.lit("transcript_id"), key("o_orderkey").cast("string"), F.lit("FPKM"), key("o_custkey").cast("string")).alias("attrs"), sample(key("o_orderkey")).alias("sample_id"), F.floor(key("o_orderkey") / 1000).alias("block"), key("o_orderkey").alias("place"),
    )
    parts = x.select(
        F.lit("c").alias("seqid"), F.when(F.col("l_linenumber") == 7, "CDS").otherwise("exon").alias("feature"), key("l_linenumber").cast("long").alias("start"), (key("l_linenumber") + 1).cast("long").alias("end"), F.lit("+").alias("strand"),
        F.create_map(F.lit("transcript_id"), key("l_orderkey").cast("string")).alias("attrs"), sample(key("l_orderkey")).alias("sample_id"), F.lit(0).cast("long").alias("block"), key("l_orderkey").alias("place"),
    )
    return heads.select(columns).unionByName(parts.select(columns)).withColumn("is_ref", F.col("sample_id") == ingest.REFERENCE)


_SAMPLE = "CASE WHEN {0} % 21 = 20 THEN 'R' ELSE CAST({0} % 21 AS VARCHAR) END"


@query(f"""WITH h AS (SELECT {_SAMPLE.format("o_orderkey")} AS sample_id, o_orderkey, CAST(o_custkey AS DOUBLE) AS e FROM orders WHERE o_orderkey % 11 <> 0),
n AS (SELECT *, sample_id || '.T' || row_number() OVER (PARTITION BY sample_id ORDER BY o_orderkey) AS tx FROM h),
x AS (SELECT {_SAMPLE.format("l_orderkey")} AS sample_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS start FROM lineitem WHERE l_linenumber <> 7)
SELECT 'transcript' AS feature, sample_id, tx, 0::BIGINT AS start, CASE WHEN sample_id = 'R' THEN 0.0::DOUBLE ELSE e END AS expr, sample_id = 'R' AS is_ref, NULL::VARCHAR AS problem FROM n
UNION ALL SELECT 'exon', x.sample_id, n.tx, x.start, NULL, x.sample_id = 'R', CASE WHEN n.tx IS NULL THEN 'exon without a transcript' END FROM x LEFT JOIN n ON n.o_orderkey = x.l_orderkey""")
def aggregate_rekey_union(spark, d):
    return ingest.aggregated(_sample_features(spark, d), order=["block", "place"]).select("feature", "sample_id", "tx", "start", "expr", "is_ref", "problem")


@query("""WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'own' || s_suppkey END AS own FROM supplier)
SELECT 'sample' || s_suppkey || '.gtf' AS gtf, coalesce(own, CAST(sum(CASE WHEN own IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY s_suppkey) AS VARCHAR)) AS sample_id FROM s""")
def sample_manifest_ids(spark, d):
    own = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("\town"), F.col("s_suppkey").cast("string"))).otherwise("")
    lines = _table(spark, d, "supplier").select(F.concat(F.lit("sample"), F.col("s_suppkey").cast("string"), F.lit(".gtf"), own).alias("value"), "s_suppkey")
    return text.parse_manifest(lines, ["s_suppkey"])


@query(f"""WITH {EXONS} SELECT seqid, start, "end", transcript_id, note, count(*) AS n FROM (SELECT seqid, start, "end", CAST(tx AS VARCHAR) AS transcript_id, CASE WHEN tx % 2 = 0 THEN 'b c' END AS note FROM exons WHERE tx % 5 <> 0 AND tx % 7 <> 0) GROUP BY ALL""")
def gtf_parse_attrs(spark, d):
    e = exons(spark, d)
    number = F.when(F.col("tx") % 5 == 0, "x1").otherwise((F.col("start") + 1).cast("string"))
    note = F.when(F.col("tx") % 2 == 0, F.lit(' note "a"; note "b c" ;')).otherwise("")
    fields = [F.col("seqid").cast("string"), F.lit("s"), F.lit("exon"), number, F.col("end").cast("string"), F.lit("."), F.col("strand"), F.lit("."), F.concat(F.lit("transcript_id "), F.col("tx").cast("string"), F.lit(";"), note)]
    lines = e.select(F.when(F.col("tx") % 7 == 0, F.concat(F.lit("#"), F.concat_ws("\t", *fields))).otherwise(F.concat_ws("\t", *fields)).alias("value"))
    f = text.parse_gtf(lines).select(F.col("seqid").cast("long").alias("seqid"), "start", "end", F.col("attrs")["transcript_id"].alias("transcript_id"), F.try_element_at("attrs", F.lit("note")).alias("note"))
    return f.groupBy("seqid", "start", "end", "transcript_id", "note").agg(F.count(F.lit(1)).alias("n"))


_FEATURES = """f AS (SELECT DISTINCT seqid, CASE WHEN tx % 3 = 0 THEN 'transcript' ELSE 'exon' END AS feature, start, "end", strand FROM exons)"""


@query(f"""WITH {EXONS}, {_FEATURES} SELECT *, row_number() OVER (ORDER BY seqid, start, feature DESC, "end", strand) AS position FROM f""")
def sorted_features(spark, d):
    f = exons(spark, d).select("seqid", F.when(F.col("tx") % 3 == 0, "transcript").otherwise("exon").alias("feature"), "start", "end", "strand").distinct()
    return intervals.numbered(text.sorted_features(f), ["start", F.desc("feature"), "end", "strand"], "position")


@query(f"""WITH {TX}, i AS (SELECT seqid, "end" AS s, lead(start) OVER (PARTITION BY tx ORDER BY start) AS e FROM tx_exons) SELECT seqid, s AS pos FROM i WHERE e IS NOT NULL UNION SELECT seqid, e FROM i WHERE e IS NOT NULL""")
def splice_sites(spark, d):
    return splice.splice_sites(tx_exons(spark, d), ["seqid", "tx"])


@query(f"""WITH {TX}, t AS (SELECT seqid, tx, strand, min(start) AS start, max("end") AS "end" FROM tx_exons GROUP BY seqid, tx, strand)
SELECT seqid, tx, CASE strand WHEN '+' THEN 0 WHEN '-' THEN 1 ELSE 2 END AS code, CASE strand WHEN '+' THEN 'pos' WHEN '-' THEN 'neg' ELSE 'none' END AS name, CASE WHEN strand = '-' THEN "end" ELSE start END AS tss FROM t""")
def tss_positions(spark, d):
    t = transcripts.transfrags(tx_exons(spark, d), ["seqid", "tx", "strand"])
    code = arrays.strand_code(arrays.strand_text(arrays.strand_code(F.col("strand"))))
    return t.select("seqid", "tx", code.alias("code"), arrays.strand_name(code).alias("name"), transcripts.tss().alias("tss"))


_STREAM = """WITH {E}, q AS (SELECT DISTINCT seqid, start, "end", strand FROM exons WHERE strand <> '.' AND start % 4 = 0), r AS (
SELECT q.seqid, q.start AS q_start, q."end" AS q_end, q.strand, CASE WHEN {M} THEN b.start - (q."end" + 1) ELSE q.start - 1 - b."end" END AS distance FROM q JOIN exons b ON q.seqid = b.seqid
AND CASE WHEN {M} THEN b.start - (q."end" + 1) ELSE q.start - 1 - b."end" END BETWEEN 0 AND 299)
SELECT seqid, q_start, q_end, strand, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seqid, q_start, q_end, strand ORDER BY distance) AS rank FROM r) WHERE rank <= 2"""


def _stream(spark, d, side):
    e = exons(spark, d)
    q = e.where("strand <> '.' AND start % 4 = 0").select("seqid", "start", "end", "strand").distinct().withColumn("q", F.struct("seqid", "start", "end", "strand"))
    return intervals.nearest_interval(q, e.select("seqid", "start", "end"), side, 2, 300).select("seqid", "q_start", "q_end", "strand", "distance", "rank")


@query(_STREAM.format(E=EXONS, M="q.strand = '-'"))
def upstream_intervals(spark, d):
    return _stream(spark, d, "upstream")


@query(_STREAM.format(E=EXONS, M="q.strand <> '-'"))
def downstream_intervals(spark, d):
    return _stream(spark, d, "downstream")


@query(f"""WITH {EXONS}, a AS (SELECT *, max("end") OVER (PARTITION BY seqid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY seqid ORDER BY start, "end", reach NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM a),
c AS (SELECT 'L' || row_number() OVER (ORDER BY seqid, island) AS locus_id, seqid, island FROM (SELECT DISTINCT seqid, island FROM b))
SELECT locus_id, seqid, tx, start, "end", count(*) AS n FROM b JOIN c USING (seqid, island) GROUP BY ALL""")
def features_by_locus(spark, d):
    e = exons(spark, d).select("seqid", "tx", "start", "end")
    return intervals.located(e, cut(intervals.loci(e), "loci"), ["locus_id"]).groupBy("locus_id", "seqid", "tx", "start", "end").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EXONS}, p AS (SELECT seqid, list_sort(list(DISTINCT start)) AS a FROM exons GROUP BY seqid)
SELECT seqid, len(list_filter(a, lambda v: v < 1000)) AS below, len(list_filter(a, lambda v: v <= 1000)) AS upto, list_filter(a, lambda v: v > 1000 AND v <= 1100) AS inside,
CAST(coalesce(list_sum(list_filter(a[3:6], lambda v: v IS NOT NULL)), 0) AS DOUBLE) AS padded FROM p""")
def array_lookups(spark, d):
    a = F.col("a")
    p = exons(spark, d).groupBy("seqid").agg(F.array_sort(F.collect_set("start")).alias("a"))
    part = arrays.padded_slice(a.cast("array<double>"), F.lit(10).cast("long"), F.lit(12).cast("long"), F.lit(16).cast("long"))
    at = F.lit(1000).cast("long")
    return p.select("seqid", arrays.bisect_left(a, at).cast("long").alias("below"), arrays.bisect_right(a, at).cast("long").alias("upto"), arrays.between(a, at, F.lit(1100).cast("long")).alias("inside"), F.aggregate(part, F.lit(0.0), lambda x, y: x + y).alias("padded"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_transcript_check(spark, d):
    return transcripts.duplicates(_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""WITH {TX}, plain AS (SELECT * FROM tx_exons WHERE strand = '.'), h AS (SELECT p.seqid, p.tx, bool_or(k.strand = '+') AS plus, bool_or(k.strand = '-') AS minus FROM plain p LEFT JOIN tx_exons k ON k.seqid = p.seqid AND k.strand <> '.' AND p.start < k."end" AND k.start < p."end" GROUP BY ALL)
SELECT seqid, tx, coalesce(plus, false) AS plus, coalesce(minus, false) AS minus FROM h""")
def strand_evidence(spark, d):
    return splice.strand_evidence(tx_exons(spark, d), ["seqid", "tx"])


def _imputed(rounds: int) -> str:
    """Rounds of imputation; those after the last decision change nothing."""
    parts = ["x0 AS MATERIALIZED (SELECT seqid, tx, strand, start, \"end\" FROM tx_exons)"]
    for k in range(rounds):
        parts.append(f"""d{k} AS MATERIALIZED (SELECT p.seqid, p.tx, bool_or(k.strand = '+') AS plus, bool_or(k.strand = '-') AS minus FROM x{k} p JOIN x{k} k ON k.seqid = p.seqid AND k.strand <> '.' AND p.start < k."end" AND k.start < p."end" WHERE p.strand = '.' GROUP BY ALL)""")
        parts.append(f"""x{k + 1} AS MATERIALIZED (SELECT x.seqid, x.tx, CASE WHEN d.plus <> d.minus THEN CASE WHEN d.plus THEN '+' ELSE '-' END ELSE x.strand END AS strand, x.start, x."end" FROM x{k} x LEFT JOIN d{k} d ON d.seqid = x.seqid AND d.tx = x.tx)""")
    return ", ".join(parts)


@query(f"""WITH {TX}, {_imputed(6)} SELECT x.seqid, x.tx, x.strand, x.start, x."end", t.expr FROM x6 x JOIN tx_exons t ON t.tx = x.tx AND t.start = x.start""")
def impute_strand(spark, d):
    return splice.impute_strands(tx_exons(spark, d), ["seqid", "tx"]).select("seqid", "tx", "strand", "start", "end", "expr")


@query(f"""WITH {TX}, g AS (SELECT seqid, tx, sum(expr) AS expr FROM tx_exons GROUP BY ALL)
SELECT seqid, tx, expr, round(expr / max(expr) OVER w, 9) AS rel_frac, round(expr / (sum(expr) OVER w + 1e-10), 9) AS abs_frac, CAST(row_number() OVER (PARTITION BY seqid ORDER BY expr DESC, tx) AS INTEGER) AS rank FROM g WINDOW w AS (PARTITION BY seqid) QUALIFY rank <= 5""")
def max_isoforms(spark, d):
    g = tx_exons(spark, d).groupBy("seqid", "tx").agg(F.sum("expr").alias("expr"))
    f = transcripts.fractions(g, "seqid").where("rank <= 5")
    return f.withColumn("rel_frac", F.round("rel_frac", 9)).withColumn("abs_frac", F.round("abs_frac", 9))


@query(f"""WITH {TX}, t AS (SELECT seqid, tx, strand, min(start) AS start, max("end") AS "end", list((start, "end") ORDER BY start) AS e, count(*) AS n, sum(expr) AS expr FROM tx_exons GROUP BY seqid, tx, strand)
SELECT concat_ws(chr(9), seqid, start, "end", 'T' || tx, '0', strand, start, start, '0', n, list_aggregate(list_transform(e, lambda x: CAST(x[2] - x[1] AS VARCHAR)), 'string_agg', ',') || ',', list_aggregate(list_transform(e, lambda x: CAST(x[1] - start AS VARCHAR)), 'string_agg', ',') || ',') AS value FROM t""")
def assembly_bed12(spark, d):
    t = transcripts.transfrags(tx_exons(spark, d), ["seqid", "tx", "strand"])
    return t.select(transcripts.bed12(F.concat(F.lit("T"), F.col("tx").cast("string")), F.lit("0")).alias("value"))


@query()
def widest_paths(spark, d):
    return assembly.isoforms(tx_exons(spark, d), assembly.Options(change_point=False))


@query()
def path_graph_stats(spark, d):
    return assembly.plain_statistics(tx_exons(spark, d), assembly.Options(change_point=False))


@query()
def change_points(spark, d):
    return assembly.change_points(_daily(spark, d).withColumn("key", F.col("key").cast("string")), assembly.Options(change_point_pvalue=0.05))


BLOCKS = [(0, 100), (200, 300), (400, 500), (600, 700), (800, 900)]
CHAINS = [([0, 1, 2, 3, 4], 10.0), ([0, 2, 4], 5.0), ([0, 1, 2, 4], 2.0), ([0, 2, 3, 4], 1.0)]


def gene_lines(spark, d):
    """GTF lines of one gene for every part: four transcripts over five blocks, scaled by the part's size.

    Samples are parts' sizes; every gene stands on a sequence of its own, the minus strand for odd parts.
    """
    p = _table(spark, d, "part").select(F.col("p_partkey").alias("seqid"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"))
    rows = []
    for n, (chain, expr) in enumerate(CHAINS):
        spans = [(BLOCKS[0][0], BLOCKS[-1][1])] + [BLOCKS[b] for b in chain]
        for k, (start, end) in enumerate(spans):
            rows.append(F.struct(F.lit("exon" if k else "transcript").alias("feature"), F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"), F.lit(n).alias("n"), F.lit(k).alias("k"), F.lit(expr).alias("e")))
    # A small file of parts makes many lines; by a given number of partitions they are made and parsed by many tasks.
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seqid")
    r = p.select("*", F.explode(F.array(*rows)).alias("r")).select("*", "r.*").withColumn("score", F.lit("."))
    head = F.when(F.col("feature") == "transcript", F.col("e") * F.col("size"))
    line = text.gtf_line([("transcript_id", F.concat_ws(".", F.col("seqid").cast("string"), F.col("n").cast("string"))), ("FPKM", head)])
    return r.select(line.alias("value"), F.col("size").cast("string").alias("sample_id"), F.col("seqid").alias("block"), (F.col("n") * 16 + F.col("k")).alias("place"))


def _assembled(spark, d):
    features = text.parse_gtf(gene_lines(spark, d)).withColumn("is_ref", F.lit(False))
    rows = ingest.aggregated(features, order=["block", "place"])
    return assembly.assembled(ingest.transfrags_of(rows), assembly.Options(min_expr=0.0))


_GENES = """g AS (SELECT p_partkey AS seqid, p_size AS size, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part),
i AS (SELECT seqid, strand, w * size AS expr, rank, e, w / 11 AS rel, w / 18 AS abs FROM g, (VALUES (0, 11.0::DOUBLE, [0, 200, 400, 600, 800]), (1, 6.0, [0, 400, 800]), (2, 1.0, [0, 200, 400, 800])) v(rank, w, e)),
ids AS (SELECT *, dense_rank() OVER (ORDER BY CAST(seqid AS VARCHAR)) AS g, row_number() OVER (ORDER BY CAST(seqid AS VARCHAR), rank) AS t FROM i)"""


@query(f"""WITH {_GENES} SELECT CAST(seqid AS VARCHAR) AS seqid, strand, 'L' || g AS locus_id, 'G' || g AS gene_id, 'TSS' || g AS tss_id, 'TU' || t AS transcript_id, round(expr, 6) AS expr, round(rel, 6) AS rel_frac, round(abs, 6) AS abs_frac, CAST(len(e) AS INTEGER) AS n_exons FROM ids""")
def assign_ids(spark, d):
    found = _assembled(spark, d).isoforms()
    return found.select("seqid", "strand", "locus_id", "gene_id", "tss_id", "transcript_id", F.round("expr", 6).alias("expr"), F.round("rel_frac", 6).alias("rel_frac"), F.round("abs_frac", 6).alias("abs_frac"), F.size("exons").alias("n_exons"))


_ATTRS = """'locus_id "L' || g || '"; gene_id "G' || g || '"; tss_id "TSS' || g || '"; transcript_id "TU' || t || '";'"""


@query(f"""WITH {_GENES}, l AS (SELECT *, CAST(floor(1000 * rel + 0.5) AS INTEGER) AS score FROM ids)
SELECT concat_ws(chr(9), seqid, 'strandloom', 'transcript', '1', '900', score, strand, '.', 'expr "' || printf('%.3f', round(expr, 3)) || '"; rel_frac "' || printf('%.5f', rel) || '"; abs_frac "' || printf('%.5f', abs) || '"; ' || {_ATTRS}) AS value FROM l
UNION ALL SELECT concat_ws(chr(9), seqid, 'strandloom', 'exon', s + 1, s + 100, score, strand, '.', {_ATTRS}) FROM (SELECT *, unnest(e) AS s FROM l)""")
def assembly_gtf(spark, d):
    return assembly.assembly_gtf(_assembled(spark, d).isoforms())


@query(f"""WITH {_GENES} SELECT concat_ws(chr(9), seqid, '0', '900', 'G' || g || '|TU' || t || '(' || printf('%.1f', round(expr, 1)) || ')', CAST(floor(1000 * rel + 0.5) AS INTEGER), strand, '0', '0', '0', len(e), repeat('100,', len(e)), array_to_string(e, ',') || ',') AS value FROM ids""")
def assembly_bed(spark, d):
    return assembly.assembly_bed(_assembled(spark, d).isoforms())


@query(f"""WITH {_GENES}, c AS (SELECT * FROM g, (VALUES (0, 18.0::DOUBLE), (200, 12), (400, 18), (600, 11), (800, 18)) v(s, w))
SELECT concat_ws(chr(9), seqid, 'strandloom', 'node', s + 1, s + 100, '0', strand, '.', 'graph_id "G_' || seqid || '_0_900_' || strand || '"; expr_min "' || CAST(w * size AS VARCHAR) || '"; expr_max "' || CAST(w * size AS VARCHAR) || '"; expr_mean "' || CAST(w * size AS VARCHAR) || '"; ref_starts ""; ref_stops "";') AS value FROM c""")
def splice_graph_gtf(spark, d):
    return assembly.graph_gtf(_assembled(spark, d).found)


@query(f"""WITH {_GENES}, k AS (SELECT * FROM g, (VALUES (1, 5, 77.0::DOUBLE), (2, 6, 59.0), (3, 6, 41.0), (4, 5, 28.0)) v(k, n, w))
SELECT CAST(seqid AS VARCHAR) AS seqid, 0::BIGINT AS start, 900::BIGINT AS "end", strand, k::BIGINT AS k, 5::BIGINT AS kmax, 4::BIGINT AS transfrags, n::BIGINT AS kmers, 0::BIGINT AS short_transfrags, 0::BIGINT AS lost_kmers, w * size AS tot_expr, 0.0::DOUBLE AS lost_expr, 0.0::DOUBLE AS lost_expr_frac, 1::BIGINT AS valid FROM k""")
def optimal_k(spark, d):
    return assembly.path_statistics(_assembled(spark, d).found)


def _ramps(spark, d):
    """A ramp of coverage for every supplier: 50 weak transfrags over all of it, 20 strong ones that end one by one."""
    s = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("seqid"), F.when(F.col("s_suppkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.explode(F.sequence(F.lit(0), F.lit(69))).alias("tx"))
    strong = F.col("tx") >= 50
    t = s.select("seqid", "strand", "tx", F.when(strong, 10.0).otherwise(1.0).alias("expr"), F.lit(False).alias("is_ref"), F.lit(1000).cast("long").alias("start"), F.when(strong, F.col("tx") + 1050).otherwise(1220).cast("long").alias("end"))
    t = t.withColumn("length", F.col("end") - F.col("start")).withColumn("exons", F.array(F.struct("start", "end")))
    return assembly.assembled(t, assembly.Options(min_transfrag_length=0))


@query("""SELECT s_suppkey AS seqid, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 1110::BIGINT AS pos, -1 AS sign FROM supplier""")
def change_points_of_ramps(spark, d):
    return _ramps(spark, d).of("changept").select(F.col("seqid").cast("long").alias("seqid"), "strand", "pos", "sign")


@query("""WITH t AS (SELECT s_suppkey AS seqid, least(1050 + k, 1110) AS e FROM supplier, range(50, 70) r(k) UNION ALL SELECT s_suppkey, 1220 FROM supplier, range(50) r(k))
SELECT seqid, CAST(e AS BIGINT) AS "end", count(*) AS n FROM t GROUP BY ALL""")
def trim_transfrags(spark, d):
    t = _ramps(spark, d).of("transfrag")
    return t.groupBy(F.col("seqid").cast("long").alias("seqid"), "end").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TX}, g AS (SELECT seqid, tx, sum(expr) AS expr FROM tx_exons GROUP BY ALL)
SELECT seqid, tx, round(expr / max(expr) OVER w, 9) AS rel_frac, round(expr / (sum(expr) OVER w + 1e-10), 9) AS abs_frac FROM g WINDOW w AS (PARTITION BY seqid)""")
def isoform_fractions(spark, d):
    g = tx_exons(spark, d).groupBy("seqid", "tx").agg(F.sum("expr").alias("expr"))
    return transcripts.fractions(g, "seqid").select("seqid", "tx", F.round("rel_frac", 9).alias("rel_frac"), F.round("abs_frac", 9).alias("abs_frac"))
