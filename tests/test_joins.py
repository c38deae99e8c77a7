"""Joins of tables that grow with the input are not broadcast from the driver, however small a planner takes them for."""

import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry
from strandloom import queries
from strandloom.operators import graphs, splice
from strandloom.plans import assembly
from strandloom.sources import ingest

SMALL = "/root/testdata/sf0.001"


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are cut meanwhile."""
    seen: list[str] = []
    for module in (graphs, splice, assembly, ingest, queries):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", lambda df, label="cut", f=module.cut: (seen.append(plan(df)), f(df, label))[1])
    return seen


def test_labels_of_components_are_not_broadcast(spark, plans):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (7, 8)], "src long, dst long")
    got = sorted(tuple(r) for r in graphs.components(edges).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("name", ["assembly_bed", "assembly_gtf", "assign_ids", "optimal_k", "splice_graph_gtf"])
def test_an_assembly_broadcasts_nothing_by_part(spark, plans, name):
    found = entry.queries()[name](spark, SMALL)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in [*plans, plan(found)])
    assert not found.isEmpty()
