"""Components: what a kernel settles in runs of edges, and what is left to rounds over whole tables."""

import random

import pytest

import __spark_entry__ as entry
from strandloom import queries
from strandloom.operators import graphs, splice

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(monkeypatch):
    """(label, plan, table) of all tables that are cut meanwhile."""
    made: list[tuple] = []

    def watched(df, label="cut", f=graphs.cut):
        made.append((label, df._jdf.queryExecution().executedPlan().toString(), out := f(df, label)))
        return out

    for module in (graphs, splice, queries):
        monkeypatch.setattr(module, "cut", watched)
    return made


def brute(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    least = {n: n for e in edges for n in e}
    while True:
        was = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if was == least:
            return sorted(least.items())


def test_rounds_hold_no_nodes_that_a_run_of_edges_settles(spark, tables):
    edges = [(100 * k + i, 100 * k + i + 1) for k in range(300) for i in range(39)]
    got = sorted(tuple(r) for r in graphs.components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == [(100 * k + i, 100 * k) for k in range(300) for i in range(40)]
    rounds = [t.count() for label, _, t in tables if label == "labels"]
    assert rounds and max(rounds) < len(got) / 100


_R = random.Random(5)
GRAPHS = {
    "chain": [(i, i + 1) for i in range(200)],
    "hub": [(i, 500) for i in range(150)] + [(500, i) for i in range(600, 700)],
    "random": [(_R.randrange(300), _R.randrange(300)) for _ in range(160)],
    "far": [(i, 10**12 - i) for i in range(100)] + [(10**12 - i, i + 1) for i in range(50)],
    "loops and repeats": [(5, 5), (7, 8), (7, 8), (8, 7), (-3, -3), (-3, 5)],
}


@pytest.mark.parametrize("chunk", [1, 16, 1 << 19])
@pytest.mark.parametrize("name", GRAPHS)
def test_runs_of_any_length_give_the_same_components(spark, monkeypatch, name, chunk):
    monkeypatch.setattr(graphs, "cut", lambda df, label="cut": df.localCheckpoint())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        df = spark.createDataFrame(GRAPHS[name], "src long, dst long").repartition(3)
        got = sorted(tuple(r) for r in graphs.components(df, chunk).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(GRAPHS[name])


def test_null_ends_other_types_and_no_edges(spark):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(graphs.components(spark.createDataFrame([(1, 2), (None, 2), (3, None)], "src int, dst long"))) == [(1, 1), (2, 1)]
    assert rows(graphs.components(spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "src string, dst string"))) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert rows(graphs.components(spark.createDataFrame([], "src long, dst long"))) == []


def test_exons_of_weak_components_are_made_once(spark, tables):
    found = entry.queries()["weak_components"](spark, SMALL)
    assert sum("lineitem" in plan for _, plan, _ in tables) == 1
    assert not found.isEmpty()
