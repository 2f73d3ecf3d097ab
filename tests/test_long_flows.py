"""Flows of more steps than a fixed bound of 40."""

from graphloom.operators import flows, passes
from graphloom.sources import frontends


def test_a_value_handed_through_many_assignments(spark):
    steps = "".join(f" a{i} = a{i - 1};" for i in range(1, 21))
    text = f"void f() {{ int a0 = source();{steps} sink(a20); }}"
    graph = passes.derive_layers(frontends.build_graph(spark.createDataFrame([("long.c", text)], "path string, text string")))
    found = flows.find_flows(graph, flows.TaintSpec(("source",), ("sink",))).collect()
    assert [(r["method"], r["origin"]) for r in found] == [("f", "source()")]
    assert found[0]["depth"] > 40
