"""Sources that are nested deeply or broken, very large files, and conditions inside traversals."""

import pytest

from graphloom.operators import passes
from graphloom.plans.traversal import QueryError, compile_query, query
from graphloom.sources import frontends


@pytest.mark.parametrize(
    ("text", "language", "calls"),
    [
        ("int f(void) { return " + "(" * 3000 + "g()" + ")" * 3000 + "; }", "c", 1),
        ("int f(void) { " + "{" * 3000 + "g();" + "}" * 3000 + " }", "c", 1),
        ("int f(int a) { " + "if (a) { g(); } else " * 2000 + "{ g(); } }", "c", 2001),
        ("x = " + "+".join(["1"] * 20000) + "\ny = g()\n", "python", 1),
        ("int f(void) { g(1; ", "c", 1),
    ],
)
def test_deep_sources_are_read(text, language, calls):
    got = frontends.build("a", text, language)
    assert sum(n["kind"] == "CALL" and n.get("name") == "g" for n in got.nodes) == calls


def test_ids_of_large_files_have_rooms_of_their_own():
    ids = {frontends.node_id(f, p, n) for f, p in ((5, "a"), (6, "b")) for n in (0, 1, frontends.ROOM - 1, frontends.ROOM, 3 * frontends.ROOM)}
    assert len(ids) == 10 and all(0 <= i < 1 << 62 for i in ids)


@pytest.fixture(scope="module")
def graph(spark):
    rows = [("a.py", "def f(x):\n    y = g(x)\n    return y\n\ndef g(z):\n    return h(z, 1)\n\ndef h(a, b):\n    return a\n")]
    return passes.derive_layers(frontends.build_graph(spark.createDataFrame(rows, "path string, text string")))


def test_conditions_end_in_values_and_flows(graph):
    names = lambda q: sorted(r["value"] for r in query(graph, q).rows.collect())
    assert names('cpg.ret.where(_.reachableBy(cpg.parameter.name("x"))).method.name') == ["f"]
    assert names('cpg.method.where(_.call.property("x")).name') == []
    assert names("cpg.method.where(_.parameter.limit(1)).name.dedup.sorted") == ["f", "g", "h"]
    assert names('cpg.identifier.name("z").repeat(_.astParent)(until(_.isMethod)).name') == ["g"]
    with pytest.raises(QueryError):
        compile_query("cpg.call.where(_.size)")
