"""Value flow, slices, summaries and source-to-sink queries, as joins and fixpoints over edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import reach, reached, shortest_paths
from ..plans.graph import Graph
from ..plans.storage import kept
from .passes import marks_ahead


def positions(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Arguments (call, arg, k) and parameters (method, param, k), both numbered from 0; the receiver has -1."""
    args = graph.e("ARGUMENT").select(F.col("src").alias("call"), F.col("dst").alias("arg"), (F.col("ord") - 1).alias("k"))
    args = args.unionByName(graph.e("RECEIVER").select(F.col("src").alias("call"), F.col("dst").alias("arg"), F.lit(-1).alias("k")))
    params = graph.parameters().select("method", F.col("id").alias("param"), F.col("index").alias("k"))
    return args, params


def exits(graph: Graph) -> DataFrame:
    """(method, exit)."""
    return graph.of_kind("METHOD_RETURN").select(F.col("method_id").alias("method"), F.col("id").alias("exit"))


def local_flow(graph: Graph) -> DataFrame:
    """(src, dst): reaching definitions, without what goes straight from an argument to a call that is resolved, and without
    variables that are alive at a method's end but not returned."""
    args, _ = positions(graph)
    resolved = graph.e("CALL").select(F.col("src").alias("call")).distinct()
    through = args.join(resolved, "call", "left_semi").select(F.col("arg").alias("src"), F.col("call").alias("dst"))
    alive = graph.of_kind("METHOD_RETURN").select(F.col("id").alias("dst")).join(graph.e("REACHING_DEF").where("property IS DISTINCT FROM '<RET>'").select("src", "dst"), "dst").select("src", "dst")
    return graph.e("REACHING_DEF").select("src", "dst").distinct().join(through.unionByName(alive), ["src", "dst"], "left_anti")


def parameter_flows(graph: Graph, sanitizers: list[str] | None = None, external: DataFrame | None = None) -> DataFrame:
    """summary_flow (method, k): parameters that reach the return, through callees as their own summaries say.

    One walk from all parameters: when one comes to its method's end, the edges from that argument to the method's calls are
    added, over which what has been reached before goes on. external (name, k) are models of functions that have no body.
    """
    args, params = positions(graph)
    base = local_flow(graph)
    targets = graph.call_targets().select("call", F.col("target").alias("method"))
    blocked = graph.calls().where(F.col("name").isin(sanitizers)).select("id") if sanitizers else None
    outs = exits(graph)
    if external is not None:
        known = graph.calls().join(graph.e("CALL").select(F.col("src").alias("id")), "id", "left_anti").join(external, "name").select(F.col("id").alias("call"), "k")
        base = base.unionByName(args.join(known, ["call", "k"]).select(F.col("arg").alias("src"), F.col("call").alias("dst")))
    seed = kept(params.select("method", "k", F.col("param").alias("origin")), "params")
    if blocked is not None:
        blocked = kept(blocked.select(F.col("id").alias("node")).distinct(), "blocked")
        base = base.join(blocked.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    steps = kept(base.distinct(), "steps")
    sites = args.join(targets, "call").select("method", "k", F.col("arg").alias("src"), F.col("call").alias("dst"))
    sites = kept(sites if blocked is None else sites.join(blocked.withColumnRenamed("node", "dst"), "dst", "left_anti").select("method", "k", "src", "dst"), "sites")
    ends = kept(outs.join(seed, "method").select("origin", F.col("exit").alias("node"), "method", "k"), "ends")
    frontier = kept(seed.select("origin", F.col("origin").alias("node")), "walk")
    seen, flows, bridges, depth = frontier, seed.select("method", "k").limit(0), steps.limit(0), 0
    hop = lambda at, over: at.join(over, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"))
    while not frontier.isEmpty():
        depth += 1
        fresh = kept(frontier.join(ends, ["origin", "node"]).select("method", "k").distinct(), "flows")
        more = kept(sites.join(fresh, ["method", "k"]).select("src", "dst").distinct(), "bridges")
        # what is new goes on over all steps, what has been seen over the new bridges
        new = hop(frontier, steps.unionByName(bridges)).unionByName(hop(seen, more)).distinct()
        frontier = kept(new.join(seen, ["origin", "node"], "left_anti"), "walk")
        seen = seen.unionByName(frontier)
        flows, bridges = flows.unionByName(fresh), bridges.unionByName(more)
        if depth % 8 == 0:
            seen, flows, bridges = kept(seen, "seen"), kept(flows, "flows"), kept(bridges, "bridges")
    return flows.distinct()


def value_flow(graph: Graph, flows: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """value_flow (src, dst, kind): DataDependence, Summary (through, into and out of callees), External, Global."""
    args, params = positions(graph)
    targets = graph.call_targets().select("call", F.col("target").alias("method"))
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("kind"))
    out = edge(local_flow(graph), "src", "dst", "DataDependence")
    out = out.unionByName(edge(args.join(targets, "call").join(params, ["method", "k"]), "arg", "param", "Summary"))
    out = out.unionByName(edge(targets.join(exits(graph), "method"), "exit", "call", "Summary"))
    if flows is not None:
        out = out.unionByName(edge(args.join(targets, "call").join(flows, ["method", "k"]), "arg", "call", "Summary"))
    if external is not None:
        alone = graph.calls().select(F.col("id").alias("call"), "name").join(targets.select("call"), "call", "left_anti").join(external, "name")
        out = out.unionByName(edge(args.join(alone, ["call", "k"]), "arg", "call", "External"))
    # an assignment to a global reaches every read of it in other methods
    refs = graph.e("REF").select(F.col("src").alias("id"))
    free = graph.of_kind("IDENTIFIER").join(refs, "id", "left_anti").select("id", "name", "method_id")
    left = args.where("k = 0").join(graph.calls().where(F.col("name").isin("=", "<operator>.assignment")).select(F.col("id").alias("call")), "call").select(F.col("arg").alias("id"))
    writes = free.join(left, "id", "left_semi").select(F.col("id").alias("src"), "name", F.col("method_id").alias("_m"))
    reads = free.join(left, "id", "left_anti").select(F.col("id").alias("dst"), "name", "method_id")
    both = writes.join(reads, "name").where("_m <> method_id")
    return out.unionByName(both.select("src", "dst", F.lit("Global").alias("kind")))


def backward_slice(graph: Graph, criteria: DataFrame, depth: int = 3, max_nodes: int | None = None) -> DataFrame:
    """(node, hops) that criteria (id) depend on: definitions at no cost, callers' arguments and callees' returns one hop each.

    Definitions within a method are followed in one pass over it, however long they are; a round is a step between methods.
    """
    args, params = positions(graph)
    rd = graph.e("REACHING_DEF").select("src", "dst")
    targets = graph.call_targets().select("call", F.col("target").alias("method"))
    up = params.join(targets, "method").join(args, ["call", "k"]).select(F.col("param").alias("dst"), F.col("arg").alias("src"))
    down = targets.join(exits(graph), "method").join(rd, F.col("exit") == F.col("dst")).select(F.col("call").alias("dst"), "src")
    own = graph.nodes.where("method_id IS NOT NULL").select("id", "method_id")
    placed = rd.join(own.withColumnRenamed("id", "src"), "src", "left").join(own.select(F.col("id").alias("dst"), F.col("method_id").alias("_to")), "dst", "left")
    placed = kept(placed.select("src", "dst", F.when(F.col("method_id") == F.col("_to"), F.col("method_id")).alias("method_id")), "slice-local")
    inside, across = placed.where("method_id IS NOT NULL"), placed.where("method_id IS NULL").select("src", "dst", F.lit(0).alias("cost"))
    steps = kept(across.unionByName(up.unionByName(down).select("src", "dst", F.lit(1).alias("cost"))), "slice-steps")
    frontier = kept(criteria.select(F.col("id").alias("node"), F.lit(0).alias("hops")).distinct(), "slice")
    seen = frontier.limit(0)
    while not frontier.isEmpty():
        marks = frontier.join(own, F.col("node") == F.col("id")).select("id", "method_id", F.col("hops").alias("value"))
        ahead = marks_ahead(inside, marks).select(F.col("id").alias("node"), F.col("value").alias("hops"))
        new = frontier.unionByName(ahead).groupBy("node").agg(F.min("hops").alias("hops"))
        better = kept(new.join(seen.withColumnRenamed("hops", "_had"), "node", "left").where("_had IS NULL OR hops < _had").select("node", "hops"), "slice")
        seen = kept(seen.unionByName(better).groupBy("node").agg(F.min("hops").alias("hops")), "slice")
        new = better.join(steps, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), (F.col("hops") + F.col("cost")).alias("hops")).where(F.col("hops") <= depth).groupBy("node").agg(F.min("hops").alias("hops"))
        frontier = kept(new.join(seen.withColumnRenamed("hops", "_had"), "node", "left").where("_had IS NULL OR hops < _had").select("node", "hops"), "slice")
    return seen if max_nodes is None else seen.orderBy("hops", "node").limit(max_nodes)


def slice_rows(graph: Graph, found: DataFrame) -> DataFrame:
    files = graph.files.select("file_id", F.col("path").alias("file")) if graph.files is not None else None
    rows = found.join(graph.nodes.withColumnRenamed("id", "node"), "node")
    rows = rows.join(files, "file_id", "left") if files is not None else rows.withColumn("file", F.lit(None).cast("string"))
    names = graph.methods().select(F.col("id").alias("method_id"), F.col("full_name").alias("method"))
    return rows.join(names, "method_id", "left").select(F.col("node").alias("node_id"), "kind", "file", "line", "code", "method", "hops")


def call_returns(graph: Graph, base: DataFrame, sanitizers: DataFrame | None = None, cap: int = 64) -> DataFrame:
    """summary_call_return (method, name): which of the base calls' (method, name) results come back from each method, at most
    cap names each, in order. What passes through a sanitizing method comes back no more."""
    calls = graph.nodes.select(F.col("id").alias("call"), "method_id").join(graph.call_targets().select("call", "target"), "call").select(F.col("method_id").alias("dst"), F.col("target").alias("src"))
    names = base.select(F.col("name").alias("origin"), F.col("method").alias("node"))
    got = reach(names, calls, sanitizers)
    from pyspark.sql.window import Window as W

    rank = F.row_number().over(W.partitionBy("node").orderBy("origin"))
    return got.withColumn("_r", rank).where(F.col("_r") <= cap).select(F.col("node").alias("method"), F.col("origin").alias("name"))


@dataclass(frozen=True)
class TaintSpec:
    """Names of sources, sinks and sanitizers: `name`, `name@k` (argument from 0), `::name` (without receiver), `recv.name`."""

    sources: tuple[str, ...] = ()
    sinks: tuple[str, ...] = ()
    sanitizers: tuple[str, ...] = ()
    source_methods: tuple[str, ...] = ()
    source_idents: tuple[str, ...] = ()
    out_param_sources: tuple[str, ...] = ()  # name@out<k>
    confiners: tuple[str, ...] = field(default=())


def _split(spec: str) -> tuple[str, str | None, int | None, bool]:
    """name, receiver, argument, bare."""
    name, _, at = spec.partition("@")
    bare = name.startswith("::")
    receiver, _, name = name.removeprefix("::").rpartition(".")
    return name, receiver or None, int(at.removeprefix("out")) if at.removeprefix("out").isdigit() else None, bare


def calls_matching(graph: Graph, specs: tuple[str, ...]) -> DataFrame:
    """(id, k): calls that any spec names; k is the argument it asks for, or null."""
    rows = [_split(s) for s in specs]
    table = graph.nodes.sparkSession.createDataFrame([(n, r, k, b) for n, r, k, b in rows], "name string, _r string, k int, _bare boolean")
    return graph.calls().join(table, "name").where("(_r IS NULL OR receiver_name = _r) AND (NOT _bare OR receiver_name IS NULL)").select("id", "k")


def find_flows(graph: Graph, spec: TaintSpec, max_depth: int | None = None) -> DataFrame:
    """findings (method, sink, sink_line, origin, path, depth): for each pair of source and sink the shortest witness.

    Paths climb out of methods first and go down into callees afterwards, and pass over calls by their summaries, so
    a value never returns to another caller than it came from. A sanitizer's call is a cut in the graph. Witnesses of
    any length are found; with max_depth those of more steps are not.
    """
    args, params = positions(graph)
    cut = graph.calls().where(F.col("name").isin([_split(s)[0] for s in spec.sanitizers])).select("id") if spec.sanitizers else None
    flows = parameter_flows(graph, [_split(s)[0] for s in spec.sanitizers])
    targets = graph.call_targets().select("call", F.col("target").alias("method"))
    local = local_flow(graph).unionByName(args.join(targets, "call").join(flows, ["method", "k"]).select(F.col("arg").alias("src"), F.col("call").alias("dst")))
    globals_ = value_flow(graph).where("kind = 'Global'").select("src", "dst")
    up = targets.join(exits(graph), "method").select(F.col("exit").alias("src"), F.col("call").alias("dst"))
    down = args.join(targets, "call").join(params, ["method", "k"]).select(F.col("arg").alias("src"), F.col("param").alias("dst"))
    # a node is doubled: 2n may still climb, 2n + 1 is on the way down
    two = lambda df, a, b: df.select((F.col("src") * 2 + a).alias("src"), (F.col("dst") * 2 + b).alias("dst"))
    steps = two(local, 0, 0).unionByName(two(local, 1, 1)).unionByName(two(up, 0, 0)).unionByName(two(down, 0, 1)).unionByName(two(down, 1, 1)).unionByName(two(globals_, 0, 0)).unionByName(two(globals_, 1, 0))
    seeds = calls_matching(graph, spec.sources).select("id")
    if spec.source_methods:
        m = graph.methods().where(F.col("name").isin(*spec.source_methods) | F.col("full_name").isin(*spec.source_methods)).select(F.col("id").alias("method"))
        seeds = seeds.unionByName(params.join(m, "method").select(F.col("param").alias("id")))
    if spec.source_idents:
        refs = graph.e("REF").select(F.col("src").alias("id"))
        seeds = seeds.unionByName(graph.of_kind("IDENTIFIER").where(F.col("name").isin(*spec.source_idents)).join(refs, "id", "left_anti").select("id"))
    if spec.out_param_sources:
        seeds = seeds.unionByName(calls_matching(graph, spec.out_param_sources).join(args.withColumnRenamed("call", "id"), ["id", "k"]).select(F.col("arg").alias("id")))
    wanted = calls_matching(graph, spec.sinks)
    ends = wanted.withColumnRenamed("k", "_k").join(args.withColumnRenamed("call", "id"), "id").where("_k IS NULL OR _k = k").select(F.col("arg").alias("node"), F.col("id").alias("sink"))
    blocked = None if cut is None else cut.select((F.col("id") * 2).alias("node")).unionByName(cut.select((F.col("id") * 2 + 1).alias("node")))
    paths = shortest_paths(seeds.select((F.col("id") * 2).alias("origin"), (F.col("id") * 2).alias("node")), steps, ends.select((F.col("node") * 2).alias("node")).unionByName(ends.select((F.col("node") * 2 + 1).alias("node"))), blocked, max_depth)
    paths = paths.select(F.shiftright("origin", 1).alias("source"), F.shiftright("node", 1).alias("node"), "depth", F.transform("path", lambda x: F.shiftright(x, 1)).alias("path"))
    best = paths.join(ends, "node").groupBy("source", "sink").agg(F.min(F.struct("depth", "path")).alias("b"))
    sink = graph.nodes.select(F.col("id").alias("sink"), F.col("name").alias("sink_name"), F.col("line").alias("sink_line"), "method_id", "file_id")
    source = graph.nodes.select(F.col("id").alias("source"), F.coalesce("code", "name").alias("origin"))
    method = graph.methods().select(F.col("id").alias("method_id"), F.coalesce("full_name", "name").alias("method"))
    return best.join(sink, "sink").join(source, "source").join(method, "method_id", "left").select("method", F.col("sink_name").alias("sink"), "sink_line", "file_id", "origin", F.concat("b.path", F.array("sink")).alias("path"), F.col("b.depth").alias("depth"), F.col("sink").alias("sink_id"), F.col("source").alias("source_id"))


def steps_of(graph: Graph, findings: DataFrame) -> DataFrame:
    """(source_id, sink_id, place, code, line, provenance, callee): a row for each step of each witness."""
    steps = findings.select("source_id", "sink_id", F.posexplode("path").alias("place", "id"))
    nodes = graph.nodes.select("id", F.coalesce("code", "name").alias("code"), "line", "kind", "method_id")
    callee = graph.call_target().join(graph.methods().select(F.col("id").alias("target"), F.coalesce("full_name", "name").alias("callee")), "target").select(F.col("call").alias("id"), "callee")
    rows = steps.join(nodes, "id").join(callee, "id", "left")
    return rows.select("source_id", "sink_id", "place", "code", "line", F.when(F.col("callee").isNotNull() & (F.col("place") > 0), "SummaryFlow").otherwise("IntraProc").alias("provenance"), "callee")


# facts with provenance


def fact_closure(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """base (a, b) to facts (a, b, derived) and supports (a, b, via): each derived pair with the steps that gave it first."""
    seen = kept(base.select("a", "b", F.lit(False).alias("derived"), F.lit(None).cast("long").alias("via")).distinct(), "facts")
    frontier = seen
    while not frontier.isEmpty():
        new = frontier.select("a", F.col("b").alias("via")).join(base.select(F.col("a").alias("via"), "b"), "via").groupBy("a", "b").agg(F.min("via").alias("via"))
        frontier = kept(new.join(seen, ["a", "b"], "left_anti").select("a", "b", F.lit(True).alias("derived"), "via"), "facts")
        seen = seen.unionByName(frontier)
    return seen.select("a", "b", "derived"), seen.where("derived").select("a", "b", "via")


def invalidated_by(supports: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (id) with all that rest on them; supports (fact_id, support_id)."""
    return reached(facts.select("id"), supports.select(F.col("support_id").alias("src"), F.col("fact_id").alias("dst"))).select(F.col("node").alias("id"))


def support_chain(supports: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (id) with all that they rest on."""
    return reached(facts.select("id"), supports.select(F.col("fact_id").alias("src"), F.col("support_id").alias("dst"))).select(F.col("node").alias("id"))
