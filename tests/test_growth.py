"""Steps whose intermediate rows must not grow faster than the input: results by hand, and what they write."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import export, flows, rules
from graphloom.plans import traversal
from graphloom.plans.graph import EDGES, NODES, Graph, shaped
from graphloom.queries import QUERIES
from graphloom.sources import derive


@pytest.fixture
def written(spark):
    """Counts the rows written to the shared folder since the test began, and the tables."""
    at = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(at.iterdir())

    def count():
        new = [p for p in at.iterdir() if p not in before]
        return sum(spark.read.parquet(str(p)).count() for p in new), len(new)

    return count


def graph(spark, nodes, edges):
    """nodes (id, kind, method_id, name, line), edges (src, dst, kind)."""
    n = spark.createDataFrame(nodes, "id long, kind string, method_id long, name string, line int")
    return Graph(shaped(n, NODES), shaped(spark.createDataFrame(edges, "src long, dst long, kind string"), EDGES))


def test_authz_writes_no_pairs_of_dominators(spark, written):
    # a straight method of 1,200 calls has 720,000 such pairs; a branch's check doesn't dominate what follows it
    n = 1200
    nodes = [(1, "METHOD", 1, "f", None), (5001, "METHOD", 5001, "g", None)] + [(i, "CALL", 1, "view" if i in (5, 9) else "purchase" if i in (3, n) else "x", i) for i in range(2, n + 1)]
    nodes += [(5002, "CALL", 5001, "if", 1), (5003, "CALL", 5001, "view", 2), (5004, "CALL", 5001, "purchase", 3), (5005, "CALL", 5001, "view", 4), (5006, "CALL", 5001, "purchase", 5), (6002, "CALL", 6001, "purchase", 1)]
    flow = [(i, i + 1) for i in range(1, n)] + [(5001, 5002), (5002, 5003), (5002, 5004), (5003, 5004), (5004, 5005), (5005, 5006)]
    g = graph(spark, nodes, [(a, b, "CFG") for a, b in flow])
    calls = lambda name: g.calls_named(name).select("id", "method_id", "line")
    got = rules.annotate_authz(g, calls("purchase"), calls("view")).select("id", "authz").collect()
    assert {tuple(r) for r in got} == {(3, "authz-partial@5"), (n, "authz-dominated@5"), (5004, "authz-partial@2"), (5006, "authz-dominated@4"), (6002, None)}
    assert written()[0] < 2 * n


def test_slice_of_a_long_method_takes_no_round_a_step(spark, written):
    # 300 definitions in a row, and one that comes from a node of no method
    n = 300
    nodes = [(i, "CALL", 1, "x", i) for i in range(1, n + 1)] + [(900, "CALL", None, "y", None), (901, "CALL", 2, "z", 1), (902, "CALL", 2, "z", 2)]
    rd = [(i, i + 1) for i in range(1, n)] + [(900, 7), (901, 900), (902, 901)]
    g = graph(spark, nodes, [(a, b, "REACHING_DEF") for a, b in rd])
    got = flows.backward_slice(g, g.nodes.where(F.col("id") == n).select("id"), depth=1)
    assert {tuple(r) for r in got.select("node", "hops").collect()} == {(i, 0) for i in [*range(1, n + 1), 900, 901, 902]}
    assert written()[1] < 20


def test_trade_reads_the_tables_once(spark):
    g = derive.trade_program(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in g.edges._jdf.queryExecution().toString() and g.e("CALL").count() == 75


def test_schema_violations_join_the_edges_once_by_each_end(spark):
    nodes = [(1, "METHOD", 1, "f", 1), (2, "CALL", 1, "c", 1), (3, None, 1, "n", 1), (4, "CALL", 1, "d", 1), (4, "CALL", 1, "d", 1)]
    edges = [(1, 2, "AST"), (2, 1, "AST"), (3, 2, "AST"), (9, 8, "AST"), (9, 8, "AST"), (None, 2, "REF"), (2, None, "REF"), (9, 2, "CFG"), (2, 1, "CFG"), (4, 2, "ODD")]
    g = graph(spark, nodes, edges)
    allowed = spark.createDataFrame([("AST", "METHOD", "CALL")], "kind string, src_kind string, dst_kind string")
    got = export.schema_violations(g.nodes, g.edges, allowed, ["METHOD", "CALL"], ["AST", "REF", "CFG"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("duplicate-id", 4, "2"), ("unknown-node-kind", 3, None), ("unknown-edge-kind", 4, "ODD"), ("illegal-ends", 2, "AST CALL METHOD"), ("illegal-ends", 3, "AST CALL"), ("dangling-src", None, "REF"), ("dangling-dst", None, "REF"), ("dangling-src", 9, "CFG")]
        + [("dangling-src", 9, "AST"), ("dangling-dst", 8, "AST")] * 2, key=str,
    )
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 4 and "LeftAnti" not in plan


def test_absorb_counts_reads_lines_from_what_it_wrote(spark, written):
    got = QUERIES["absorb_counts"](spark, "/root/testdata/sf0.001")
    assert written()[1] == 2 and "l_orderkey" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_round_of_repeat_moves_only_edges_near_its_nodes(spark):
    g = derive.containment(spark, "/root/testdata/sf0.001")
    rows = g.of_kind("BLOCK").where("name = '1-URGENT'").select(*g.nodes.columns)
    got = traversal._near_hop(g, rows, *traversal.HOPS["astParent"])
    assert got.select("kind").distinct().collect() == [("METHOD",)] and got.count() == rows.count()
    assert "BETWEEN" in got._jdf.queryExecution().optimizedPlan().toString().upper() or ">=" in got._jdf.queryExecution().optimizedPlan().toString()
