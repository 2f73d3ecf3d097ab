"""python -m graphloom COMMAND: build, query, scan, flow, slice, apis, export, vectors, methods and calls of a saved graph."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import export, flows, passes, rules
from .plans.graph import Graph
from .plans.traversal import QueryError, compile_query
from .sources import frontends


def confined(root: str, part: str) -> str:
    """root/part, which must stay inside root."""
    top = Path(root).resolve()
    at = (top / part).resolve()
    if at != top and top not in at.parents:
        raise SystemExit(f"{part} is outside {root}")
    return str(at)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple) -> None:
        s = sub.add_parser(name)
        for flag, options in args:
            s.add_argument(flag, **options)

    graph = ("graph", {"help": "folder of a saved graph"})
    add("build", ("root", {}), ("graph", {}), ("--module", {"default": "."}), ("--exclude", {"action": "append", "default": []}))
    add("query", graph, ("text", {}))
    add("scan", graph, ("pack", {"help": "JSON file of rules"}), ("--sarif", {"help": "file to write"}))
    add("flow", graph, ("--source", {"action": "append", "required": True}), ("--sink", {"action": "append", "required": True}), ("--sanitizer", {"action": "append", "default": []}))
    add("slice", graph, ("call", {}), ("--depth", {"type": int, "default": 3}), ("--max-nodes", {"type": int, "default": None}))
    add("apis", graph, ("--examples", {"type": int, "default": 3}))
    add("export", graph, ("out", {}), ("--repr", {"choices": list(export.REPRESENTATIONS), "default": "ast"}), ("--format", {"choices": ["dot", "graphml", "json"], "default": "dot"}))
    add("vectors", graph, ("out", {}), ("--dimensions", {"type": int, "default": None}))
    add("methods", graph)
    add("calls", graph)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "query":  # malformed text ends before Spark starts
        try:
            plan = compile_query(a.text)
        except QueryError as e:
            print(e, file=sys.stderr)
            return 2
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "build":
        found = frontends.read_sources(spark, confined(a.root, a.module))
        passes.derive_layers(frontends.build_graph(found, tuple(a.exclude))).save(a.graph)
        return 0
    g = Graph.load(spark, a.graph)
    if a.command == "query":
        show(plan(g).rows.select("*"))
    elif a.command == "scan":
        pack = rules.load_pack(Path(a.pack).read_text())
        for w in pack.warnings:
            print(w, file=sys.stderr)
        found = rules.run_pack(g, pack)
        if a.sarif:
            meta = spark.createDataFrame([(r.id, r.severity, r.description) for r in pack.rules], "id string, severity string, description string")
            Path(a.sarif).write_text(export.sarif(found, meta).first()["text"])
        else:
            show(found.orderBy("rule_id", "sink_file", "sink_line"))
    elif a.command == "flow":
        show(flows.find_flows(g, flows.TaintSpec(tuple(a.source), tuple(a.sink), tuple(a.sanitizer))))
    elif a.command == "slice":
        show(flows.slice_rows(g, flows.backward_slice(g, g.calls_named(a.call).select("id"), a.depth, a.max_nodes)).orderBy("file", "line"))
    elif a.command == "apis":
        show(rules.external_apis(g, a.examples).orderBy(F.desc("n"), "name"))
    elif a.command == "export":
        ending = {"dot": "dot", "graphml": "graphml", "json": "json"}[a.format]
        made = {"dot": export.dot, "graphml": export.graphml, "json": export.json_units}[a.format](g, a.repr)
        made.join(export.unit_files(g, ending), "unit", "left").write.mode("overwrite").parquet(a.out)
    elif a.command == "vectors":
        export.vectors(g, a.dimensions).write.mode("overwrite").parquet(a.out)
    elif a.command == "methods":
        show(g.methods().select("id", "full_name", "line").orderBy("id"))
    elif a.command == "calls":
        show(g.calls().select("id", "name", "code", "line").orderBy("id"))
    return 0


def show(df) -> None:
    """Rows as lines of JSON, one partition at a time."""
    for line in df.toJSON().toLocalIterator():
        print(line)


if __name__ == "__main__":
    sys.exit(main())
