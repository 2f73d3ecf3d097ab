"""A traversal language, compiled to DataFrame plans.

`cpg.method.name("x.*").callee.where(_.call).name.size` becomes joins, filters and semi-joins over nodes and edges;
Catalyst does the rest. Names must match in full. Results are bags: a hop keeps how often a node is reached, closures
(`ast`, `reachableBy`) and `dedup` give each node once. Text that is not understood raises QueryError when it is
compiled, before anything runs, and nothing follows a terminal step.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .fixpoint import reach, reached, shortest_paths
from .graph import Graph
from .storage import kept


class QueryError(ValueError):
    """A query that can't be compiled."""


_TOKEN = re.compile(r"""\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>\d+)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<sign>&&|\|\||[().,!_]))""")

#: step on nodes by kind
KINDS = {
    "annotation": "ANNOTATION", "block": "BLOCK", "call": "CALL", "closureBinding": "CLOSURE_BINDING", "comment": "COMMENT", "configFile": "CONFIG_FILE", "controlStructure": "CONTROL_STRUCTURE", "dependency": "DEPENDENCY",
    "fieldIdentifier": "FIELD_IDENTIFIER", "file": "FILE", "finding": "FINDING", "identifier": "IDENTIFIER", "imports": "IMPORT", "jumpTarget": "JUMP_TARGET", "literal": "LITERAL", "local": "LOCAL", "member": "MEMBER", "metaData": "META_DATA",
    "method": "METHOD", "methodRef": "METHOD_REF", "methodReturn": "METHOD_RETURN", "modifier": "MODIFIER", "namespace": "NAMESPACE", "namespaceBlock": "NAMESPACE_BLOCK", "parameter": "METHOD_PARAMETER_IN", "ret": "RETURN", "tag": "TAG",
    "typ": "TYPE", "typeDecl": "TYPE_DECL", "typeRef": "TYPE_REF", "unknown": "UNKNOWN",
}
#: kind filters
IS = {"isCall": "CALL", "isMethod": "METHOD", "isIdentifier": "IDENTIFIER", "isReturn": "RETURN", "isAnnotation": "ANNOTATION", "isLiteral": "LITERAL", "isBlock": "BLOCK", "isControlStructure": "CONTROL_STRUCTURE", "isTypeDecl": "TYPE_DECL", "isParameter": "METHOD_PARAMETER_IN"}
#: step: edge kind, direction, kinds of the nodes reached
HOPS = {
    "astChildren": ("AST", "out", None), "astParent": ("AST", "in", None), "callee": ("CALL", "out", None), "caller": ("CALL", "in", None), "refsTo": ("REF", "out", None), "referencingIdentifiers": ("REF", "in", None), "evalType": ("EVAL_TYPE", "out", None),
    "sourceFile": ("SOURCE_FILE", "out", None), "parameterLink": ("PARAMETER_LINK", "out", None), "baseTypeDecl": ("INHERITS_FROM", "out", None), "derivedTypeDecl": ("INHERITS_FROM", "in", None), "capture": ("CAPTURE", "out", None), "captured": ("CAPTURE", "in", None),
    "cfgNext": ("CFG", "out", None), "cfgPrev": ("CFG", "in", None), "dominatedBy": ("DOMINATE", "in", None), "dominates": ("DOMINATE", "out", None), "postDominatedBy": ("POST_DOMINATE", "in", None), "postDominates": ("POST_DOMINATE", "out", None),
    "controls": ("CONDITION", "out", None), "controlledBy": ("CONDITION", "in", None), "receiver": ("RECEIVER", "out", None), "inCall": ("ARGUMENT", "in", ("CALL",)), "ddgIn": ("REACHING_DEF", "in", None), "ddgOut": ("REACHING_DEF", "out", None),
}
PROPERTIES = {"name": "name", "code": "code", "fullName": "full_name", "label": "kind", "typeFullName": "type_full_name", "signature": "signature", "lineNumber": "line", "order": "order_", "argumentIndex": "argument_index", "version": "version", "modifierType": "modifier_type", "importedEntity": "imported_entity", "importedAs": "imported_as", "dependencyGroupId": "dependency_group_id", "id": "id"}
TERMINAL = ("size", "toJson", "toJsonPretty", "browse", "p", "clone", "l", "head")


@dataclass
class Step:
    name: str
    args: list | None  # None without parentheses
    chained: list | None = None  # the second list of repeat(...)(...)


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"can't read {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.i = 0

    def peek(self) -> str | None:
        return self.tokens[self.i][1] if self.i < len(self.tokens) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.i >= len(self.tokens) or (want and self.tokens[self.i][1] != want):
            raise QueryError(f"expected {want or 'more'}, found {self.peek() or 'the end'}")
        self.i += 1
        return self.tokens[self.i - 1]

    def chain(self, root: str) -> list[Step]:
        if self.take()[1] != root:
            raise QueryError(f"a query starts with {root}")
        steps = []
        while self.peek() == ".":
            self.take()
            kind, name = self.take()
            if kind != "name":
                raise QueryError(f"expected a step, found {name}")
            step = Step(name, self.arguments() if self.peek() == "(" else None)
            if name == "repeat":
                step.chained = self.arguments()
            steps.append(step)
        return steps

    def arguments(self) -> list:
        self.take("(")
        out = []
        while self.peek() != ")":
            kind, value = self.tokens[self.i] if self.i < len(self.tokens) else (None, None)
            if kind == "string":
                out.append(re.sub(r"\\(.)", r"\1", self.take()[1][1:-1]))
            elif kind == "number":
                out.append(int(self.take()[1]))
            elif value in ("true", "false"):
                out.append(self.take()[1] == "true")
            elif value in ("_", "cpg"):
                out.append(("cpg" if value == "cpg" else "_", self.chain(value)))
            elif kind == "name":
                self.take()
                out.append((value, self.arguments() if self.peek() == "(" else []))
            else:
                raise QueryError(f"unexpected {value or 'end'}")
            if self.peek() == ",":
                self.take()
            elif self.peek() == "." and isinstance(out[-1], tuple):
                # options of repeat are chained: emit.maxDepth(2)
                self.take()
                continue
        self.take(")")
        return out


@dataclass
class Result:
    """rows: node columns plus `row`, or one column `value`; kind is nodes, values, number or paths."""

    rows: DataFrame
    kind: str


def compile_query(text: str) -> Callable[[Graph], Result]:
    parser = Parser(text)
    steps = parser.chain("cpg")
    if parser.peek() is not None:
        raise QueryError(f"unexpected {parser.peek()}")
    check(steps, True)
    return lambda graph: run(graph, steps)


def check(steps: list[Step], root: bool) -> None:
    if root and not steps:
        raise QueryError("a query needs a step")
    ended = None
    for i, s in enumerate(steps):
        if ended:
            raise QueryError(f"{ended} is terminal")
        known = s.name in KINDS or s.name in IS or s.name in HOPS or s.name in PROPERTIES or s.name in _STEPS or s.name in TERMINAL or s.name.removesuffix("Exact") in PROPERTIES or s.name.removesuffix("Not") in PROPERTIES
        if not known:
            raise QueryError(f"unsupported step {s.name}")
        if root and i == 0 and s.name not in KINDS and s.name != "all":
            raise QueryError(f"{s.name} can't start a query")
        if not root and (s.name in TERMINAL or s.name == "reachableByFlows"):
            raise QueryError(f"{s.name} can't stand inside a condition")
        if s.name in TERMINAL or (s.name in PROPERTIES and s.args is None and i + 1 < len(steps) and steps[i + 1].name not in (*TERMINAL, "dedup", "limit", "take", "sorted")):
            if s.name in TERMINAL:
                ended = s.name
            else:
                raise QueryError(f"{steps[i + 1].name} can't follow {s.name}")
        for a in (s.args or []) + (s.chained or []):
            if isinstance(a, tuple) and a[0] in ("_", "cpg"):
                check(a[1], a[0] == "cpg")
            elif isinstance(a, tuple) and isinstance(a[1], list):
                for b in a[1]:
                    if isinstance(b, tuple) and b[0] == "_":
                        check(b[1], False)
        for f in (s.args or []) if s.name in PROPERTIES or s.name in KINDS else []:
            if isinstance(f, str):
                try:
                    re.compile(f)
                except re.error as e:
                    raise QueryError(f"{f!r} is no pattern: {e}") from None


def full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _hop(graph: Graph, rows: DataFrame, kind: str, way: str, kinds) -> DataFrame:
    a, b = ("src", "dst") if way == "out" else ("dst", "src")
    keep = [c for c in ("_row",) if c in rows.columns]
    hop = rows.select(F.col("id").alias(a), *keep).join(graph.e(kind).select(a, F.col(b).alias("id")), a).drop(a)
    nodes = graph.nodes if not kinds else graph.of_kind(*kinds)
    return hop.join(nodes, "id").select(*graph.nodes.columns, *keep)


def _between(df: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """df where a column lies between the least and the largest id of rows, which are written."""
    lo, hi = rows.agg(F.min("id"), F.max("id")).first()
    return df.where(F.col(column).between(F.lit(lo), F.lit(hi))) if lo is not None else df.limit(0)


def _near_hop(graph: Graph, rows: DataFrame, kind: str, way: str, kinds) -> DataFrame:
    """_hop for rounds: ids come first, and edges and nodes out of their range aren't moved; only the nodes met are read in full."""
    a, b = ("src", "dst") if way == "out" else ("dst", "src")
    keep = [c for c in ("_row",) if c in rows.columns]
    start = kept(rows.select("id", *keep), "hop")
    hop = start.withColumnRenamed("id", a).join(_between(graph.e(kind), start, a).select(a, F.col(b).alias("id")), a).drop(a)
    met = kept(hop, "hop")
    return met.join(_between(graph.nodes if not kinds else graph.of_kind(*kinds), met, "id"), "id").select(*graph.nodes.columns, *keep)


def _inside(graph: Graph, rows: DataFrame, kinds) -> DataFrame:
    """Nodes of kinds within the same methods."""
    keep = [c for c in ("_row",) if c in rows.columns]
    return rows.select(F.col("id").alias("method_id"), *keep).join(graph.of_kind(*kinds), "method_id").select(*graph.nodes.columns, *keep)


def _closure(graph: Graph, rows: DataFrame, kind: str) -> DataFrame:
    keep = [c for c in ("_row",) if c in rows.columns]
    if keep:
        all_ = reach(rows.select(F.col("id").alias("origin"), F.col("id").alias("node")), graph.e(kind))
        found = rows.select(F.col("id").alias("origin"), *keep).join(all_, "origin").select(F.col("node").alias("id"), *keep).distinct()
    else:
        found = reached(rows.select("id"), graph.e(kind)).select(F.col("node").alias("id"))
    return found.join(graph.nodes, "id").select(*graph.nodes.columns, *keep)


def _satisfied(graph: Graph, rows: DataFrame, steps: list[Step]) -> DataFrame:
    """Ids of rows for which the inner traversal finds anything; each id is tried once."""
    once = rows.dropDuplicates(["id"]).withColumn("_row", F.col("id"))
    return apply(graph, once, steps).rows.select(F.col("_row").alias("id")).distinct()


def _filter_property(rows: DataFrame, name: str, args: list) -> DataFrame:
    exact, negate = name.endswith("Exact"), name.endswith("Not")
    c = F.col(PROPERTIES[name.removesuffix("Exact").removesuffix("Not")])
    if not args:
        raise QueryError(f"{name} needs an argument")
    if exact or not isinstance(args[0], str):
        hit = c.isin(*args)
    else:
        hit = F.lit(False)
        for p in args:
            hit = hit | c.rlike(full(p))
    return rows.where(~hit if negate else hit)


def _repeat(graph: Graph, rows: DataFrame, s: Step) -> DataFrame:
    inner = next((a[1] for a in s.args if isinstance(a, tuple) and a[0] == "_"), None)
    if inner is None:
        raise QueryError("repeat needs a traversal")
    options = {a[0]: a[1] for a in s.chained or [] if isinstance(a, tuple)}
    times = options.get("times", options.get("maxDepth", [None]))[0]
    until = options["until"][0][1] if options.get("until") else None
    emit, skip_first = "emit" in options or "emitAllButFirst" in options, "emitAllButFirst" in options
    if times is None and until is None:
        raise QueryError("repeat needs times, maxDepth or until")
    now, out = rows, [rows] if emit and not skip_first else []
    depth = 0
    walked = None  # without times a node is walked once, in the round that first reaches it, so that cycles end
    while times is None or depth < times:
        depth += 1
        if times is None and inner and inner[0].name in HOPS:
            now = apply(graph, _near_hop(graph, now, *HOPS[inner[0].name]), inner[1:]).rows
        else:
            now = apply(graph, now, inner).rows
        if times is None:
            ids = ["id"] + [c for c in ("_row",) if c in now.columns]
            now = kept(now if walked is None else now.join(walked, ids, "left_anti"), "repeat")
            walked = now.select(*ids).distinct() if walked is None else walked.union(now.select(*ids).distinct())
        if until is not None:
            done = _satisfied(graph, now, until)
            hit, now = now.join(done, "id", "left_semi").select(*now.columns), now.join(done, "id", "left_anti").select(*now.columns)
            out.append(hit)
            if times is None and now.isEmpty():
                break
        if emit:
            out.append(now)
    if not emit and (times is not None or until is None):
        out.append(now)
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


def apply(graph: Graph, rows: DataFrame, steps: list[Step]) -> Result:
    kind = "nodes"
    for s in steps:
        n = s.name
        if kind == "values":
            if n == "size":
                return Result(rows.agg(F.count(F.lit(1)).alias("value")), "number")
            if n == "dedup":
                rows = rows.distinct()
            elif n in ("limit", "take", "sorted"):
                rows = rows.orderBy("value") if n == "sorted" else rows.orderBy("value").limit(s.args[0])
            elif n not in TERMINAL:
                raise QueryError(f"{n} can't follow a property")
            continue
        if n in IS:
            rows = rows.where(F.col("kind") == IS[n])
        elif n == "argument":
            rows = _hop(graph, rows, "ARGUMENT", "out", None)
            if s.args:
                rows = rows.where(F.col("argument_index") == s.args[0])
        elif n == "method":
            keep = [c for c in ("_row",) if c in rows.columns]
            rows = rows.select(F.col("method_id").alias("id"), *keep).join(graph.methods(), "id").select(*graph.nodes.columns, *keep)
        elif n == "parameter":
            rows = _hop(graph, rows, "AST", "out", ("METHOD_PARAMETER_IN",))
        elif n == "methodReturn":
            rows = _hop(graph, rows, "AST", "out", ("METHOD_RETURN",))
        elif n == "ast":
            rows = _closure(graph, rows, "AST")
        elif n in HOPS:
            rows = _hop(graph, rows, *HOPS[n])
        elif n in KINDS and n not in PROPERTIES:
            rows = _inside(graph, rows, (KINDS[n],))
            if s.args:
                rows = _filter_property(rows, "name", s.args)
        elif n in PROPERTIES and s.args is None:
            keep = [c for c in ("_row",) if c in rows.columns]
            rows, kind = rows.where(F.col(PROPERTIES[n]).isNotNull()).select(F.col(PROPERTIES[n]).alias("value"), *keep), "values"
        elif n in PROPERTIES or n.removesuffix("Exact") in PROPERTIES or n.removesuffix("Not") in PROPERTIES:
            rows = _filter_property(rows, n, s.args or [])
        elif n == "isExternal":
            rows = rows.where(F.coalesce("is_external", F.lit(False)) == bool(s.args[0] if s.args else True))
        elif n in ("where", "filter"):
            for _, inner in s.args:
                rows = rows.join(_satisfied(graph, rows, inner), "id", "left_semi").select(*rows.columns)
        elif n in ("filterNot", "whereNot"):
            for _, inner in s.args:
                rows = rows.join(_satisfied(graph, rows, inner), "id", "left_anti").select(*rows.columns)
        elif n == "or":
            found = None
            for _, inner in s.args:
                ids = _satisfied(graph, rows, inner)
                found = ids if found is None else found.union(ids)
            rows = rows.join(found.distinct(), "id", "left_semi").select(*rows.columns)
        elif n == "and":
            for _, inner in s.args:
                rows = rows.join(_satisfied(graph, rows, inner), "id", "left_semi").select(*rows.columns)
        elif n == "has":
            rows = rows.where(F.coalesce(F.element_at("props_str", F.lit(s.args[0])).isNotNull() | F.element_at("props_int", F.lit(s.args[0])).isNotNull(), F.lit(False)))
        elif n == "property":
            value = F.coalesce(F.element_at("props_str", F.lit(s.args[0])), F.element_at("props_int", F.lit(s.args[0])).cast("array<string>"))
            rows, kind = rows.select(F.explode(value).alias("value"), *[c for c in ("_row",) if c in rows.columns]).where("value IS NOT NULL"), "values"
        elif n == "dedup":
            rows = rows.dropDuplicates(["id"] + [c for c in ("_row",) if c in rows.columns])
        elif n in ("limit", "take"):
            if "_row" in rows.columns:  # inside a condition, so many for each row that it is tried on
                rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("_row").orderBy("id"))).where(F.col("_n") <= s.args[0]).drop("_n")
            else:
                rows = rows.orderBy("id").limit(s.args[0])
        elif n == "repeat":
            rows = _repeat(graph, rows, s)
        elif n in ("reachableBy", "reachableByFlows"):
            if not s.args or s.args[0][0] != "cpg":
                raise QueryError(f"{n} needs a traversal of cpg")
            sources = run(graph, s.args[0][1]).rows.select("id")
            flow = graph.e("REACHING_DEF", "DDG")
            if n == "reachableBy":
                against, keep = flow.select(F.col("dst").alias("src"), F.col("src").alias("dst")), [c for c in ("_row",) if c in rows.columns]
                if keep:
                    back = reach(rows.select(F.col("_row").alias("origin"), F.col("id").alias("node")), against).select("node", F.col("origin").alias("_row"))
                else:
                    back = reached(rows.select("id"), against)
                found = back.join(sources.withColumnRenamed("id", "node").distinct(), "node", "left_semi").select(F.col("node").alias("id"), *keep).distinct()
                rows = found.join(graph.nodes, "id").select(*graph.nodes.columns, *keep)
            else:
                paths = shortest_paths(sources.select(F.col("id").alias("origin"), F.col("id").alias("node")), flow, rows.select("id"))
                rows, kind = paths.select(F.col("path").alias("value")), "paths"
        elif n == "size":
            return Result(rows.agg(F.count(F.lit(1)).alias("value")), "number")
        elif n == "head":
            rows = rows.orderBy("id").limit(1)
        elif n in ("toJson", "toJsonPretty"):
            own = [c for c in ("id", "kind", "name", "full_name", "code", "line") if c in rows.columns]
            return Result(rows.select(F.to_json(F.struct(*own)).alias("value")), "values")
        elif n == "p":
            return Result(rows.select("id", F.col("kind").alias("label"), F.col("line").alias("location"), "name", "code"), "table")
        elif n not in TERMINAL:
            raise QueryError(f"unsupported step {n}")
    return Result(rows, kind)


_STEPS = {"argument", "ast", "isExternal", "where", "filter", "filterNot", "whereNot", "or", "and", "has", "property", "dedup", "limit", "take", "sorted", "repeat", "reachableBy", "reachableByFlows", "all"}


def run(graph: Graph, steps: list[Step]) -> Result:
    first = steps[0]
    rows = graph.nodes if first.name == "all" else graph.of_kind(KINDS[first.name])
    if first.args:
        rows = _filter_property(rows, "name", first.args)
    return apply(graph, rows, steps[1:])


def query(graph: Graph, text: str) -> Result:
    return compile_query(text)(graph)
