import pytest

from graphloom.plans.graph import EDGES, NODES, Graph, shaped
from graphloom.plans.traversal import QueryError, compile_query, query


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(
        [(1, "METHOD", 1, "main"), (2, "CALL", 1, "getenv"), (3, "CALL", 1, "strcpy"), (4, "LITERAL", 1, "x"), (5, "METHOD", 5, "helper"), (6, "CALL", 1, "helper")], "id long, kind string, method_id long, name string"
    )
    edges = spark.createDataFrame([(1, 2, "AST", 1), (1, 3, "AST", 2), (3, 4, "AST", 1), (3, 4, "ARGUMENT", 1), (6, 5, "CALL", 0), (1, 6, "AST", 3)], "src long, dst long, kind string, ord int")
    return Graph(shaped(nodes, NODES), shaped(edges, EDGES))


def values(graph, text):
    return sorted(r[0] for r in query(graph, text).rows.collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('cpg.call.name("getenv|strcpy").size', [2]),
        ('cpg.call.name("get").size', [0]),
        ("cpg.call.callee.name", ["helper"]),
        ('cpg.method("main").call.name', ["getenv", "helper", "strcpy"]),
        ("cpg.method.ast.isCall.name", ["getenv", "helper", "strcpy"]),
        ('cpg.call.where(_.argument).name', ["strcpy"]),
        ('cpg.call.filterNot(_.argument).name', ["getenv", "helper"]),
        ("cpg.literal.inCall.name", ["strcpy"]),
        ("cpg.literal.astParent.astParent.name", ["main"]),
        ("cpg.call.method.name", ["main", "main", "main"]),
        ("cpg.call.method.dedup.name", ["main"]),
        ("cpg.call.limit(2).name", ["getenv", "strcpy"]),
        ("cpg.literal.repeat(_.astParent)(emit.maxDepth(5)).label", ["CALL", "LITERAL", "METHOD"]),
    ],
)
def test_queries(graph, text, want):
    assert values(graph, text) == want


@pytest.mark.parametrize("text", ["cpg.nothing", "cpg.call.size.name", "cpg.call.name(", 'cpg.call.name("(")', "call.name", "cpg", "cpg.call.name.callee", "cpg.call; drop", "cpg.name"])
def test_errors_come_before_running(text):
    with pytest.raises(QueryError):
        compile_query(text)


def test_saved_graphs_are_equal(spark, graph, tmp_path):
    graph.save(str(tmp_path / "g"))
    again = Graph.load(spark, str(tmp_path / "g"))
    assert sorted(r[0] for r in again.nodes.select("id").collect()) == [1, 2, 3, 4, 5, 6]
    assert again.edges.exceptAll(graph.edges).isEmpty() and graph.edges.exceptAll(again.edges).isEmpty()
