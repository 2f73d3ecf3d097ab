"""Small programs from source text to findings, exports and updates."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.__main__ import confined, main
from graphloom.operators import export, flows, passes, rules
from graphloom.plans.catalogue_analyses import PROGRAMS
from graphloom.sources import frontends
from graphloom.streaming import incremental


@pytest.fixture(scope="module")
def graph(spark):
    rows = spark.createDataFrame([("main.c", PROGRAMS["main.c"])], "path string, text string")
    return passes.derive_layers(frontends.build_graph(rows))


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("a.c", "int f(int a, int b) { return g(h(a), b); }", {"METHOD": ["f"], "CALL": ["g", "h"]}),
        ("a.java", "class A { int f(int a, int b) { if (a > 1) { g(a); } return b; } }", {"METHOD": ["f"], "CALL": [">", "g"]}),
        ("a.go", "func f(a int, b int) int { return g(a, b) }", {"METHOD": ["f"], "CALL": ["g"]}),
        ("a.js", "const f = (a, b) => { return g(a, b) }", {"METHOD": ["f"], "CALL": ["g"]}),
        ("a.ts", "function f(a: number, b: number): number { return g(a) }", {"METHOD": ["f"], "CALL": ["g"]}),
        ("a.rs", "fn f(a: i32, b: i32) -> i32 { g(a, b) }", {"METHOD": ["f"], "CALL": ["g"]}),
        ("a.scala", "def f(a: Int, b: Int): Int = { g(a, b) }", {"METHOD": ["f"], "CALL": ["g"]}),
        ("a.cpp", "int A::f(int a, int b) { return g(a, b); }", {"METHOD": ["f"], "CALL": ["g"]}),
        ("a.py", "def f(a, b):\n    return g(a, b)\n", {"METHOD": ["f"], "CALL": ["g"]}),
    ],
)
def test_every_language_builds_alike(path, text, want):
    built = frontends.build(path, text, frontends.EXTENSIONS[path.rpartition(".")[2]])
    for kind, names in want.items():
        assert sorted(n["name"] for n in built.nodes if n["kind"] == kind) == names
    assert [n["name"] for n in built.nodes if n["kind"] == "METHOD_PARAMETER_IN"] == ["a", "b"]
    assert any(n["kind"] == "RETURN" for n in built.nodes)


@pytest.mark.parametrize("text", ["", "int f(", "}}}}", "class A {", "def f(:\n  x", "f(((", "func () {"])
def test_broken_text_is_no_error(text):
    for language in (*frontends.SPECS, "python"):
        frontends.build("x", text, language)


def test_pack_and_sarif(spark, graph):
    pack = rules.load_pack(json.dumps({"rules": [{"id": "t", "sources": ["source"], "sinks": ["sink@0"], "sanitizers": ["clean"], "severity": "high"}, {"id": "s", "kind": "unbounded-scanf"}, {"id": "n", "kind": "forbidden-call", "sinks": ["gets"]}, {"id": "?", "kind": "new"}], "unknown": 1}))
    assert pack.warnings == ("?: unknown kind new",)
    found = rules.run_pack(graph, pack)
    counts = {r[0]: r[1] for r in found.groupBy("rule_id").count().collect()}
    assert counts == {"t": 5, "s": 1}
    meta = spark.createDataFrame([(r.id, r.severity, r.description) for r in pack.rules], "id string, severity string, description string")
    document = json.loads(export.sarif(found, meta).first()["text"])
    run = document["runs"][0]
    assert len(run["results"]) == 6 and len(run["tool"]["driver"]["rules"]) == 4
    assert {r["level"] for r in run["results"] if r["ruleId"] == "t"} == {"error"}


def test_witness(graph):
    found = flows.find_flows(graph, flows.TaintSpec(("source",), ("sink",))).where("method = 'direct'")
    steps = [r["code"] for r in flows.steps_of(graph, found).orderBy("place").collect()]
    assert steps[0] == "source()" and steps[-1] == "sink(x)"


def test_exports_parse(graph):
    for r in export.json_units(graph, "cpg14").collect():
        unit = json.loads(r["text"])
        ids = {n["id"] for n in unit["nodes"]}
        assert all(e["src"] in ids and e["dst"] in ids for e in unit["edges"])
    import xml.etree.ElementTree as ET

    for r in export.graphml(graph, "cfg").collect():
        ET.fromstring(r["text"])
    names = [r["file"] for r in export.unit_files(graph, "dot").collect()]
    assert len(names) == len(set(names))


def test_authz_names(spark):
    names = {"checkPermission": True, "requireAdmin": True, "authorize": True, "getUserRole": False, "hasAccess": True, "createRole": False, "permissionId": False, "isOwner": True, "parse": False, "": False}
    rows = spark.createDataFrame(list(names.items()), "name string, want boolean").withColumn("got", rules.is_authz_name(F.col("name")))
    assert rows.where("got <> want").collect() == []


def test_stream_of_files(spark, tmp_path):
    rows = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    start = frontends.build_graph(rows({"a.py": "def f(x):\n    return g(x)\n"}))
    seen = []
    rows({"a.py": "def f(x):\n    return h(x)\n"}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "in"))
    query = incremental.watch(stream, start, lambda g, n: seen.append(sorted(r[0] for r in g.calls().select("name").collect())), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert seen[-1] == ["h"]


def test_subscription(spark):
    frames = [spark.createDataFrame(r, "method string, sink string, sink_line int, origin string") for r in ([("m", "s", 1, "o")], [("m", "s", 1, "o"), ("n", "s", None, "o")], [("n", "s", None, "o")])]
    sub = incremental.Subscription(lambda g: g)
    got = [sorted((r["method"], r["change"]) for r in sub.refresh(f).collect()) for f in frames]
    assert got == [[("m", "added")], [("n", "added")], [("m", "removed")]]


def test_command_line(capsys, tmp_path):
    assert main(["query", "nowhere", "cpg.size.size"]) == 2
    with pytest.raises(SystemExit):
        confined(str(tmp_path), "../x")
