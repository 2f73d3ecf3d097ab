"""A stream of edits that is stopped and started again goes on from the saved graph, and an edit leaves other files' layers alone."""

from graphloom.operators import passes
from graphloom.plans.graph import Graph
from graphloom.sources import frontends
from graphloom.streaming import incremental

SCHEMA = "path string, text string, time long"
ONE = {"a.c": "int f(int a) { return g(a); }\n", "b.c": "int h(int a) { int x = a; return x; }\n"}


def build(spark, files):
    return passes.derive_layers(frontends.build_graph(spark.createDataFrame(list(files.items()), "path string, text string")))


def edges(graph):
    return sorted(map(tuple, graph.edges.select("src", "dst", "kind", "property").collect()), key=str)


def test_restart_goes_on_from_the_saved_graph(spark, tmp_path):
    start, seen = build(spark, ONE), []
    into, at = f"file://{tmp_path}/in", f"file://{tmp_path}/state"

    def put(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(into)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(into)
        q = incremental.watch(stream, start, lambda g, n: seen.append((n, sorted(r["name"] for r in g.methods().collect()))), at)
        q.processAllAvailable()
        q.stop()

    put("one", [("b.c", "int old(int a) { return a; }\n", 1), ("b.c", "int g(int a) { return a; }\n", 2)])
    run()
    put("two", [("c.c", "int k(void) { return f(1); }\n", 3)])
    run()
    assert seen[0][1] == ["f", "g"]  # the latest version of b.c, not the greatest text
    assert seen[-1][1] == ["f", "g", "k"]  # the first edit isn't lost
    final = Graph.load(spark, f"{at}/graph/{max(incremental._saved(spark, f'{at}/graph'))}")
    clean = build(spark, {"a.c": ONE["a.c"], "b.c": "int g(int a) { return a; }\n", "c.c": "int k(void) { return f(1); }\n"})
    assert edges(final) == edges(clean)
