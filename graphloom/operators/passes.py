"""Layers derived from a graph: references, calls, control flow, dominators, reaching definitions.

Kernels see one method at a time: its rows come sorted to one task, which reads thousands of methods from Arrow batches
and holds the rows of one. All layers of a method are made in one such pass where the pipeline wants them together; all else
is joins. A pass states the layer it writes; the pipeline clears that layer's edges first, so that running it again
changes nothing, and leaves layers alone that a graph calls authoritative.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import closure
from ..plans.graph import Graph
from ..plans.storage import kept
from . import kernels

EDGE = "src long, dst long, kind string, ord int, property string"
VIRTUAL_FAN_OUT = 16
METHOD_KINDS = ("CFG", "DOMINATE", "POST_DOMINATE", "CONDITION", "REACHING_DEF")
EDGES_A_BATCH = 1 << 16


# methods, one at a time

_ROW = ["method_id", "row", "src", "dst", "kind", "ord", "name", "code"]


def _by_method(graph: Graph, *kinds: str) -> DataFrame:
    """(method_id, src, dst, kind, ord) of edges within a method."""
    own = graph.nodes.where("method_id IS NOT NULL").select("id", "method_id")
    return graph.e(*kinds).join(own.withColumnRenamed("id", "src"), "src").select("method_id", "src", "dst", "kind", F.coalesce("ord", F.lit(0)).alias("ord"))


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select("method_id", F.lit("e").alias("row"), "src", "dst", "kind", "ord", F.lit("").alias("name"), F.lit("").alias("code"))


def _method_rows(graph: Graph, *kinds: str) -> DataFrame:
    """Nodes and edges of a method in one frame: row 'n' or 'e'."""
    n = graph.nodes.where("method_id IS NOT NULL").select(
        "method_id", F.lit("n").alias("row"), F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), "kind", F.coalesce("order_", "argument_index", F.lit(0)).alias("ord"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("code", "name", F.lit("")).alias("code")
    )
    return n.unionByName(_edge_rows(_by_method(graph, *kinds)))


class Method:
    """What the kernels need of one method."""

    def __init__(self, key: int, rows: list[list]):
        self.key, self.nodes, self.args, self.cfg, self.marks = key, {}, {}, [], {}
        _, row, src, dst, kind, place, name, code = rows
        edges = []
        for r, a, b, k, o, n, c in zip(row, src, dst, kind, place, name, code):
            if r == "n":
                self.nodes[a] = kernels.Node(a, k, n, c, o)
            elif r == "m":
                self.marks[a] = min(o, self.marks.get(a, o))
            else:
                edges.append((o, b, a, k))
        known = self.nodes or None
        for _, b, a, k in sorted(edges, key=lambda e: e[:2]):
            if known is not None and (a not in known or b not in known):
                continue
            if k == "AST":
                self.nodes[a].children.append(b)
            elif k == "ARGUMENT":
                self.args.setdefault(a, []).append(b)
            else:
                self.cfg.append((a, b))
        self.exit = next((i for i, n in self.nodes.items() if n.kind == "METHOD_RETURN"), None)
        for i, n in self.nodes.items():
            if n.kind == "RETURN":
                self.args[i] = list(n.children)

    @property
    def whole(self) -> bool:
        return self.exit is not None and self.key in self.nodes

    def control_flow(self) -> list[tuple]:
        return kernels.control_flow(self.key, self.exit, self.nodes) if self.whole else []

    def dominators(self) -> list[tuple]:
        return [(d, n) for n, d in kernels.immediate_dominators(self.key, self.cfg).items()]

    def marks_above(self) -> list[tuple]:
        return list(kernels.least_above(kernels.immediate_dominators(self.key, self.cfg), self.marks).items()) if self.marks else []

    def marks_ahead(self) -> list[tuple]:
        return list(kernels.sources_of(self.cfg, self.marks).items())

    def exits(self) -> set[int]:
        return {b for _, b in self.cfg} - {a for a, _ in self.cfg}

    def post_dominators(self) -> list[tuple]:
        return [(d, n) for n, d in kernels.post_dominators(self.exits(), self.cfg).items()]

    def control_dependences(self) -> list[tuple]:
        return list(kernels.control_dependences(self.cfg, kernels.post_dominators(self.exits(), self.cfg)))

    def reaching_definitions(self) -> list[tuple]:
        if not self.whole or not self.cfg:
            return []
        params = [i for i, n in self.nodes.items() if n.kind == "METHOD_PARAMETER_IN"]
        found: dict[tuple, str] = {}
        for a, b, v in sorted(kernels.reaching_definitions(self.key, self.exit, self.nodes, self.cfg, params, self.args)):
            found.setdefault((a, b), v)
        return [(a, b, v) for (a, b), v in found.items()]

    def last_definitions(self) -> list[tuple]:
        same: dict[str, set[int]] = {}
        calls = [i for i, n in self.nodes.items() if n.kind == "CALL"]
        for i in calls:
            same.setdefault(self.nodes[i].name, set()).add(i)
        order = list(dict.fromkeys(x for e in self.cfg for x in e))
        into, _ = kernels.gen_kill(order, self.cfg, {i: {i} for i in calls}, {i: same[self.nodes[i].name] - {i} for i in calls})
        return [(n, d) for n in calls for d in into.get(n, ())]


WORK = {"CFG": Method.control_flow, "DOMINATE": Method.dominators, "POST_DOMINATE": Method.post_dominators, "CONDITION": Method.control_dependences, "REACHING_DEF": Method.reaching_definitions, "LAST": Method.last_definitions, "ABOVE": Method.marks_above, "AHEAD": Method.marks_ahead}


def _methods_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Method]:
    """Methods from batches that are sorted by method."""
    key, held = None, [[] for _ in _ROW]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(np.diff(ids)) + 1, len(ids)]
        columns = [c.to_pylist() for c in batch.columns]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if columns[0][a] != key:
                if held[0]:
                    yield Method(key, held)
                key, held = columns[0][a], [[] for _ in _ROW]
            for h, c in zip(held, columns):
                h += c[a:b]
    if held[0]:
        yield Method(key, held)


def _per_method(rows: DataFrame, *kinds: str) -> DataFrame:
    """EDGE rows of the kinds, in the order given, of each method in rows; a CFG that is made is what the others work on."""
    placed = rows.select(*_ROW).repartition("method_id").sortWithinPartitions("method_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(5)]

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string())
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["src", "dst", "kind", "ord", "property"])
            for c in out:
                c.clear()
            return got

        for method in _methods_in(batches):
            for kind in kinds:
                pairs = sorted(WORK[kind](method))
                if kind == "CFG":
                    method.cfg = pairs
                for c, values in zip(out, ([p[0] for p in pairs], [p[1] for p in pairs], [kind] * len(pairs), range(len(pairs)), [p[2] if len(p) > 2 else None for p in pairs])):
                    c.extend(values)
            if len(out[0]) >= EDGES_A_BATCH:
                yield flush()
        if out[0]:
            yield flush()

    return placed.mapInArrow(run, EDGE)


def method_layers(graph: Graph) -> DataFrame:
    """Edges of all METHOD_KINDS from the trees, in one pass."""
    return _per_method(_method_rows(graph, "AST", "ARGUMENT"), *METHOD_KINDS)


def control_flow(graph: Graph) -> DataFrame:
    """CFG edges from the trees."""
    return _per_method(_method_rows(graph, "AST", "ARGUMENT"), "CFG")


def _of_flow(graph: Graph, cfg: DataFrame | None, kind: str) -> DataFrame:
    flow = _by_method(graph, "CFG") if cfg is None else cfg.select("method_id", "src", "dst", F.lit("CFG").alias("kind"), F.lit(0).alias("ord"))
    return _per_method(_edge_rows(flow), kind)


def dominators(graph: Graph, cfg: DataFrame | None = None) -> DataFrame:
    """DOMINATE edges (immediate dominator, node) of every method's control flow."""
    return _of_flow(graph, cfg, "DOMINATE")


def _mark_rows(marks: DataFrame) -> DataFrame:
    """marks (id, method_id, value) as rows that kernels take."""
    return marks.where("method_id IS NOT NULL AND value IS NOT NULL").select("method_id", F.lit("m").alias("row"), F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit("").alias("kind"), F.col("value").alias("ord"), F.lit("").alias("name"), F.lit("").alias("code"))


def dominating_marks(graph: Graph, marks: DataFrame) -> DataFrame:
    """(id, value): the least value of the marks (id, method_id, value) that dominate a node, for nodes that any does. One walk down each
    method's tree of dominators, as their pairs grow with the square of a method; methods without a mark aren't moved."""
    flow = _by_method(graph, "CFG").join(marks.select("method_id").distinct(), "method_id", "left_semi")
    return _per_method(_edge_rows(flow).unionByName(_mark_rows(marks)), "ABOVE").select(F.col("src").alias("id"), F.col("dst").cast("int").alias("value"))


def marks_ahead(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, value): the least value of the marks (id, method_id, value) that a node leads to within its method over edges (method_id, src,
    dst), itself included; all steps of a method in one pass. Methods without a mark aren't moved."""
    flow = edges.join(marks.select("method_id").distinct(), "method_id", "left_semi").select("method_id", "src", "dst", F.lit("REACHING_DEF").alias("kind"), F.lit(0).alias("ord"))
    return _per_method(_edge_rows(flow).unionByName(_mark_rows(marks)), "AHEAD").select(F.col("src").alias("id"), F.col("dst").cast("int").alias("value"))


def post_dominators(graph: Graph, cfg: DataFrame | None = None) -> DataFrame:
    """POST_DOMINATE edges (immediate post-dominator, node); exits are nodes without successors."""
    return _of_flow(graph, cfg, "POST_DOMINATE")


def control_dependence(graph: Graph) -> DataFrame:
    """CONDITION edges (branch, node that it decides)."""
    return _of_flow(graph, None, "CONDITION")


def reaching_definitions(graph: Graph) -> DataFrame:
    """REACHING_DEF edges with the variable as property."""
    return _per_method(_method_rows(graph, "AST", "ARGUMENT", "CFG"), "REACHING_DEF")


def last_definitions(graph: Graph) -> DataFrame:
    """(node, definition): which calls' definitions reach a call, when a call defines its name and kills others of it."""
    return _per_method(_method_rows(graph, "CFG"), "LAST").select(F.col("src").alias("node"), F.col("dst").alias("definition"))


# joins


def symbol_refs(graph: Graph) -> DataFrame:
    """REF edges: an identifier to the last parameter or local of its name in its method."""
    named = graph.of_kind("METHOD_PARAMETER_IN", "LOCAL").groupBy("method_id", "name").agg(F.max("id").alias("dst"))
    return graph.of_kind("IDENTIFIER").select("id", "method_id", "name").join(named, ["method_id", "name"]).select(F.col("id").alias("src"), "dst", F.lit("REF").alias("kind"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("property"))


def is_test_path(path: Column) -> Column:
    """Call resolution's idea of a test file, by its folders and its name."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    folders = low.rlike(r"(^|/)(tests?|testing|testdata|mocks|fakes|__tests__|__mocks__|[^/]*simulators?)/")
    base = F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    return folders | F.lower(base).rlike("^(mock_|fake_|test_)") | stem.rlike(r"(_test|_tests|_mock|_fake|\.test|\.spec)$")


def resolve_calls(graph: Graph, test_code: bool = False, only: DataFrame | None = None) -> DataFrame:
    """CALL edges by a ladder of rungs, of all calls or of only those given (id); each call takes the first rung that gives an answer.

    Candidates share the call's simple name; calls in production files see none in test files. One candidate is
    taken. With a receiver type: methods of that type (the first), else of its ancestors, else of its implementors
    (both 1 to 16; no Mock types), else nothing. Without: the only candidate in the same file, else the only one with
    as many parameters as the call has arguments, else the first.

    Calls never meet their candidates: methods are summed by name, owner, file and number of parameters to a count and the
    least id, and these meet the distinct call sites (name, hint, file, arguments); each call then takes its site's answer.
    """
    nodes = graph.nodes
    if graph.files is not None:
        nodes = nodes.join(graph.files.select("file_id", is_test_path(F.col("path")).alias("_test")), "file_id", "left")
    else:
        nodes = nodes.withColumn("_test", F.lit(False))
    test = F.coalesce("_test", F.lit(False))
    n_params = graph.parameters().groupBy("method").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("method", "target")
    n_args = graph.e("ARGUMENT").groupBy(F.col("src").alias("call")).agg(F.count(F.lit(1)).alias("_n"))
    # a method is seen from all files, or from test files alone
    seen = F.explode(F.when(test & F.lit(not test_code), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False))))
    methods = nodes.where("kind = 'METHOD' AND name IS NOT NULL").select(F.col("id").alias("target"), "name", F.col("type_full_name").alias("owner"), F.coalesce("file_id", F.lit(-1)).alias("file"), seen.alias("scope"))
    methods = kept(methods.join(n_params, "target", "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n"), "resolve-methods")
    calls = nodes.where("kind = 'CALL' AND name IS NOT NULL").select(F.col("id").alias("call"), "name", F.col("type_full_name").alias("hint"), F.coalesce("file_id", F.lit(-2)).alias("file"), "receiver_name", "method_id", test.alias("scope"))
    calls = calls if only is None else calls.join(only.select(F.col("id").alias("call")), "call", "left_semi")
    # a missing hint comes from the member of the enclosing class that the receiver names, where that is unambiguous
    fields = graph.e("AST").join(graph.of_kind("MEMBER").select(F.col("id").alias("dst"), F.col("name").alias("receiver_name"), F.col("type_full_name").alias("_t")), "dst").join(graph.of_kind("TYPE_DECL").select(F.col("id").alias("src"), F.col("name").alias("_class")), "src")
    fields = fields.groupBy("_class", "receiver_name").agg(F.min("_t").alias("_member"), F.countDistinct("_t").alias("_n")).where("_n = 1")
    owner = graph.methods().select(F.col("id").alias("method_id"), F.col("type_full_name").alias("_class"))
    calls = calls.join(owner, "method_id", "left").join(fields.drop("_n"), ["_class", "receiver_name"], "left").withColumn("hint", F.coalesce("hint", "_member"))
    site = ["scope", "name", "hint", "file", "n"]
    calls = kept(calls.join(n_args, "call", "left").withColumn("n", F.coalesce("_n", F.lit(0))).select("call", *site), "resolve-calls")
    sites = kept(calls.select(*site).distinct(), "resolve-sites")
    kin = closure(graph.of_kind("TYPE_DECL").where("bases IS NOT NULL").select(F.col("name").alias("a"), F.explode("bases").alias("b")))
    hinted = sites.where("hint IS NOT NULL").select("scope", "name", "hint").distinct()

    def related(owners: DataFrame, out: str) -> DataFrame:
        """(scope, name, hint, out): the methods of a hint's kin (hint, owner), where there are no more than VIRTUAL_FAN_OUT."""
        found = kept(hinted.join(owners, "hint").join(methods, ["scope", "name", "owner"]).select("scope", "name", "hint", "target"), "resolve-kin")
        few = found.groupBy("scope", "name", "hint").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= VIRTUAL_FAN_OUT).drop("_n")
        return found.join(few, ["scope", "name", "hint"]).groupBy("scope", "name", "hint").agg(F.sort_array(F.collect_list("target")).alias(out))

    summed = lambda *by: methods.groupBy("scope", "name", *by).agg(F.count(F.lit(1)).alias("_c"), F.min("target").alias("_m"))
    only = lambda df, out: df.where("_c = 1").withColumnRenamed("_m", out).drop("_c")
    found = (
        sites.join(summed().withColumnsRenamed({"_c": "_count", "_m": "_first"}), ["scope", "name"])
        .join(summed("owner").where("owner IS NOT NULL").withColumnsRenamed({"owner": "hint", "_m": "_own"}).drop("_c"), ["scope", "name", "hint"], "left")
        .join(related(kin.select(F.col("a").alias("hint"), F.col("b").alias("owner")), "_above"), ["scope", "name", "hint"], "left")
        .join(related(kin.select(F.col("b").alias("hint"), F.col("a").alias("owner")).where(~F.col("owner").startswith("Mock")), "_below"), ["scope", "name", "hint"], "left")
        .join(only(summed("file"), "_here"), ["scope", "name", "file"], "left")
        .join(only(summed("n"), "_fits"), ["scope", "name", "n"], "left")
    )
    one = lambda c: F.array(F.col(c))
    answer = (
        F.when(F.col("_count") == 1, one("_first"))
        .when(F.col("_own").isNotNull(), one("_own"))
        .when(F.col("hint").isNotNull(), F.coalesce("_above", "_below"))
        .otherwise(F.array(F.coalesce("_here", "_fits", "_first")))
    )
    answers = kept(found.select(*site, answer.alias("_to")).where("_to IS NOT NULL"), "resolve-answers").withColumnRenamed("hint", "_hint")
    got = calls.join(answers, [*(F.expr("hint <=> _hint") if c == "hint" else calls[c] == answers[c] for c in site)])
    return got.select(F.col("call").alias("src"), F.posexplode("_to").alias("ord", "dst")).select("src", "dst", F.lit("CALL").alias("kind"), F.col("ord").cast("int").alias("ord"), F.lit(None).cast("string").alias("property"))


# pipeline


@dataclass(frozen=True)
class Pass:
    name: str
    layer: str
    edge: str
    run: Callable[[Graph], DataFrame]
    needs: tuple[str, ...] = ()


STANDARD = [
    Pass("call graph", "CallGraph", "CALL", resolve_calls),
    Pass("control flow", "Cfg", "CFG", control_flow),
    Pass("dominators", "Cfg", "DOMINATE", dominators, ("CFG",)),
    Pass("post-dominators", "Cfg", "POST_DOMINATE", post_dominators, ("CFG",)),
    Pass("control dependence", "Cfg", "CONDITION", control_dependence, ("CFG",)),
    Pass("reaching definitions", "Ddg", "REACHING_DEF", reaching_definitions, ("CFG",)),
    Pass("symbols", "SymbolRef", "REF", symbol_refs),
]


def ordered(passes: list[Pass]) -> list[Pass]:
    """Passes after those that write what they need; in the order given where a cycle leaves no choice."""
    out, left = [], list(passes)
    while left:
        ready = next((p for p in left if not any(q.edge in p.needs for q in left if q is not p)), left[0])
        out.append(ready)
        left.remove(ready)
    return out


def derive_layers(graph: Graph, passes: list[Pass] | None = None) -> Graph:
    """All layers; those that come from single methods in one pass, unless a graph brings one of them along."""
    todo = [p for p in ordered(STANDARD if passes is None else passes) if p.layer not in graph.authoritative]
    together = [p for p in todo if p.edge in METHOD_KINDS and p in STANDARD]
    if {p.edge for p in together} == set(METHOD_KINDS):
        cleared = graph.without_edges(*METHOD_KINDS)
        graph = cleared.with_edges(kept(method_layers(cleared), "methods"))
        todo = [p for p in todo if p not in together]
    for p in todo:
        cleared = graph.without_edges(p.edge)
        graph = cleared.with_edges(kept(p.run(cleared), p.edge.lower()))
    return graph
