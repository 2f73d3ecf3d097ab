"""Rule packs, structural detectors, authorization, entry mining and links between programs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as fn
from ..plans.graph import Graph, is_analysis_method
from .flows import TaintSpec, find_flows
from .passes import dominating_marks


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str = "taint"
    name: str = ""
    description: str = ""
    cwe: str = ""
    severity: str = "medium"
    sources: tuple[str, ...] = ()
    sinks: tuple[str, ...] = ()
    sanitizers: tuple[str, ...] = ()
    entry_methods: tuple[str, ...] = ()
    source_idents: tuple[str, ...] = ()
    authz: tuple[str, ...] = ()
    confiners: tuple[str, ...] = ()
    capacity_fix: bool = False


@dataclass(frozen=True)
class RulePack:
    rules: tuple[Rule, ...]
    entry_globs: tuple[str, ...] = ()
    warnings: tuple[str, ...] = field(default=())


KINDS = ("taint", "forbidden-call", "unbounded-scanf", "discarded-return", "append-without-delete")


def load_pack(text: str) -> RulePack:
    """A pack from JSON; keys may be camelCase or snake_case, unknown keys are ignored, a rule needs an id."""
    data = json.loads(text)
    data = {"rules": data} if isinstance(data, list) else data
    rules, warnings = [], []
    for r in data.get("rules", []):
        if not r.get("id"):
            raise ValueError("a rule needs an id")
        get = lambda snake, default, r=r: r.get(snake, r.get(snake.split("_")[0] + "".join(w.title() for w in snake.split("_")[1:]), default))
        lists = {k: tuple(get(k, ())) for k in ("sources", "sinks", "sanitizers", "entry_methods", "source_idents", "authz", "confiners")}
        rule = Rule(r["id"], get("kind", "taint"), get("name", r["id"]), get("description", ""), get("cwe", ""), get("severity", "medium"), capacity_fix=bool(get("capacity_provisioning_is_fix", False)), **lists)
        if rule.kind not in KINDS:
            warnings.append(f"{rule.id}: unknown kind {rule.kind}")
        rules.append(rule)
    return RulePack(tuple(rules), tuple(data.get("entryGlobs", data.get("entry_globs", ()))), tuple(warnings))


def is_test_path(path: Column) -> Column:
    """The detectors' idea of a test file, by its name alone; it differs from call resolution's."""
    return path.rlike(r"(_test\.go|Test\.scala|Test\.java|Spec\.scala)$|(^|/)test_[^/]*$|[^/]*\.(test|spec)\.[^/]*$")


def _in_scope(graph: Graph, calls: DataFrame) -> DataFrame:
    """Calls within analysis methods of files that aren't tests, with their method's name."""
    methods = graph.methods().where(is_analysis_method(F.col("name"))).select(F.col("id").alias("method_id"), F.coalesce("full_name", "name").alias("method"))
    calls = calls.join(methods, "method_id")
    if graph.files is not None:
        calls = calls.join(graph.files.where(is_test_path(F.col("path"))).select("file_id"), "file_id", "left_anti")
    return calls


def forbidden_calls(graph: Graph, patterns: tuple[str, ...]) -> DataFrame:
    """(method, sink, line, id) of calls whose names match a glob."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | fn.pat_match(F.col("name"), p)
    return _in_scope(graph, graph.calls().where(hit)).select("method", F.col("name").alias("sink"), "line", "id")


def unbounded_scanf(graph: Graph, specs: tuple[str, ...] = ("scanf@0", "fscanf@1", "sscanf@1")) -> DataFrame:
    """Calls whose literal format has %s or %[ without a width; %* and %% are fine."""
    rows = [(s.partition("@")[0], int(s.partition("@")[2] or 0) + 1) for s in specs]
    table = graph.nodes.sparkSession.createDataFrame(rows, "name string, ord int")
    calls = graph.calls().join(table, "name")
    arg = graph.e("ARGUMENT").select(F.col("src").alias("id"), F.col("dst").alias("_a"), "ord").join(graph.of_kind("LITERAL").select(F.col("id").alias("_a"), F.col("code").alias("_f")), "_a")
    inside = F.regexp_replace(fn.literal_string(F.col("_f")), "%%", "")
    bad = calls.join(arg, ["id", "ord"]).where(inside.rlike(r"%(?:l|h)?(?:s|\[)"))
    return _in_scope(graph, bad).select("method", F.col("name").alias("sink"), "line", "id")


def discarded_returns(graph: Graph, names: tuple[str, ...]) -> DataFrame:
    """Calls whose result nobody takes: children of a block, or bound to `_`."""
    calls = graph.calls().where(F.col("name").isin(*names))
    parent = graph.e("AST").select(F.col("dst").alias("id"), F.col("src").alias("_p")).join(graph.of_kind("BLOCK").select(F.col("id").alias("_p")), "_p")
    total = calls.join(parent.select("id"), "id", "left_semi").withColumn("kind_of", F.lit("total"))
    bound = graph.calls().where(fn.is_plain_assignment(F.col("name"))).select(F.col("id").alias("_c"))
    args = graph.e("ARGUMENT").select(F.col("src").alias("_c"), F.col("dst").alias("id"), "ord")
    blank = args.where("ord = 1").join(graph.of_kind("IDENTIFIER").where("name = '_'").select("id"), "id").select("_c")
    partial = calls.join(args.where("ord = 2").join(bound, "_c").join(blank, "_c").select("id"), "id", "left_semi").withColumn("kind_of", F.lit("partial"))
    return _in_scope(graph, total.unionByName(partial)).select("method", F.col("name").alias("sink"), "line", "id", "kind_of")


def append_without_delete(calls: DataFrame, add: str, remove: str) -> DataFrame:
    """calls (method_id, name, key, ...) that add a key which the same method never removes, whatever its case."""
    key = F.lower("key")
    gone = calls.where(F.col("name") == remove).select("method_id", key.alias("_k")).distinct()
    return calls.where(F.col("name") == add).withColumn("_k", key).join(gone, ["method_id", "_k"], "left_anti").drop("_k")


def without_capacity(graph: Graph, findings: DataFrame) -> DataFrame:
    """Findings whose sink's method has no earlier capacity call on an identifier that the sink uses."""
    own = graph.e("ARGUMENT").select(F.col("src").alias("call"), F.col("dst").alias("id")).join(graph.of_kind("IDENTIFIER").select("id", F.col("name").alias("ident")), "id").groupBy("call").agg(F.collect_set("ident").alias("idents"))
    caps = graph.calls().where(fn.is_capacity_call(F.col("name"))).select(F.col("id").alias("call"), "method_id", F.col("line").alias("_line")).join(own, "call").select("method_id", "_line", F.col("idents").alias("_i"))
    sinks = findings.join(graph.calls().select(F.col("id").alias("sink_id"), "method_id"), "sink_id").join(own.withColumnRenamed("call", "sink_id"), "sink_id", "left")
    fixed = sinks.join(caps, "method_id").where((F.col("_line") < F.col("sink_line")) & F.arrays_overlap("idents", "_i")).select("sink_id").distinct()
    return findings.join(fixed, "sink_id", "left_anti")


FINDING = ["rule_id", "method", "sink", "sink_line", "sink_file", "origin", "path", "sink_id", "source_id"]


def run_pack(graph: Graph, pack: RulePack) -> DataFrame:
    """findings of all rules; kinds that aren't known give none."""
    spark = graph.nodes.sparkSession
    empty = "method string, sink string, sink_line int, file_id long, origin string, path array<bigint>, sink_id long, source_id long"
    out = None
    for r in pack.rules:
        if r.kind == "taint":
            got = find_flows(graph, TaintSpec(r.sources, r.sinks, r.sanitizers, r.entry_methods, r.source_idents)).drop("depth")
            got = without_capacity(graph, got) if r.capacity_fix else got
        else:
            found = {"forbidden-call": lambda: forbidden_calls(graph, r.sinks), "unbounded-scanf": lambda: unbounded_scanf(graph, r.sinks or ("scanf@0", "fscanf@1", "sscanf@1")), "discarded-return": lambda: discarded_returns(graph, r.sinks)}.get(r.kind)
            if found is None:
                continue
            at = graph.nodes.select("id", "file_id", F.coalesce("code", "name").alias("origin"))
            got = found().join(at, "id").select("method", "sink", F.col("line").alias("sink_line"), "file_id", "origin", F.array("id").alias("path"), F.col("id").alias("sink_id"), F.col("id").alias("source_id"))
        got = got.select(F.lit(r.id).alias("rule_id"), *[c.split()[0] for c in empty.split(", ")])
        out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], "rule_id string, " + empty)
    if graph.files is not None:
        out = out.join(graph.files.select("file_id", F.col("path").alias("sink_file")), "file_id", "left")
    else:
        out = out.withColumn("sink_file", F.lit(None).cast("string"))
    return out.select(*FINDING)


# authorization

#: Words of names that check permissions, and words that show a name does something else.
AUTHZ_ALONE = {"authorize", "authorized", "authorization", "authz", "enforce", "permitted", "canaccess"}
AUTHZ_VERBS = {"check", "verify", "require", "ensure", "validate", "assert", "has", "is", "can", "must"}
AUTHZ_NOUNS = {"access", "permission", "permissions", "perm", "role", "roles", "acl", "auth", "owner", "ownership", "admin", "privilege", "allowed", "scope"}
NOT_AUTHZ_HEADS = {"get", "set", "list", "fetch", "load", "create", "update", "delete", "add", "remove", "new", "make", "save", "put", "parse", "build", "group", "count"}
NOT_AUTHZ_TAILS = {"id", "ids", "name", "names", "key", "token", "header", "config", "list", "map", "count", "error", "request", "response", "url"}


def _words(words: set[str]) -> Column:
    return F.array(*[F.lit(w) for w in sorted(words)])


def is_authz_name(name: Column) -> Column:
    w = fn.word_tokens(name)
    head, tail = F.element_at(w, 1), F.element_at(w, -1)
    yes = F.arrays_overlap(w, _words(AUTHZ_ALONE)) | (F.arrays_overlap(w, _words(AUTHZ_VERBS)) & F.arrays_overlap(w, _words(AUTHZ_NOUNS)))
    return F.when(F.size(w) == 0, False).otherwise(yes & ~head.isin(sorted(NOT_AUTHZ_HEADS)) & ~tail.isin(sorted(NOT_AUTHZ_TAILS)))


def annotate_authz(graph: Graph, sinks: DataFrame, checks: DataFrame) -> DataFrame:
    """sinks (id, method_id, line) with authz: `authz-dominated@line` if a check (id, method_id, line) dominates the sink (the least
    such line), `authz-partial@line` if one only stands in its method, else null."""
    sure = dominating_marks(graph, checks.select("id", "method_id", F.col("line").alias("value"))).groupBy("id").agg(F.min("value").alias("_sure"))
    some = checks.groupBy("method_id").agg(F.min("line").alias("_some"))
    out = sinks.join(sure, "id", "left").join(some, "method_id", "left")
    return out.withColumn("authz", F.when(F.col("_sure").isNotNull(), F.concat(F.lit("authz-dominated@"), "_sure")).when(F.col("_some").isNotNull(), F.concat(F.lit("authz-partial@"), "_some"))).drop("_sure", "_some")


# entries

#: Calls that register handlers.
STRONG = ("HandleFunc", "Handle", "handle_func", "add_url_rule", "addRoute", "add_route", "RegisterHandler")
VERBS = ("get", "post", "put", "delete", "patch", "head", "options", "GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "Get", "Post", "Put", "Delete", "Patch")


def mine_routes(graph: Graph) -> DataFrame:
    """(route, verb, handler, line): registrations with a route literal and a handler that a method has the name of."""
    args = graph.e("ARGUMENT").select(F.col("src").alias("call"), F.col("dst").alias("id"), "ord").join(graph.nodes.select("id", F.col("kind").alias("_k"), "code", F.col("name").alias("_n")), "id")
    routes = args.where((F.col("_k") == "LITERAL") & fn.is_route_literal(F.col("code"))).groupBy("call").agg(F.min(F.struct("ord", fn.literal_string(F.col("code")).alias("route"))).alias("r")).select("call", "r.route")
    handlers = args.where(F.col("_k").isin("IDENTIFIER", "METHOD_REF", "CALL")).select("call", F.col("_n").alias("handler"), "ord")
    named = graph.methods().groupBy(F.col("name").alias("handler")).agg(F.count(F.lit(1)).alias("_same")).where("_same <= 3").select("handler")
    calls = graph.calls().where(F.col("name").isin(*STRONG, *VERBS)).select(F.col("id").alias("call"), "name", "line")
    rows = calls.join(routes, "call").join(handlers.join(named, "handler"), "call")
    return rows.select("route", F.when(F.col("name").isin(*VERBS), F.upper("name")).otherwise("ANY").alias("verb"), "handler", "line").distinct()


def link_rpcs(graph: Graph, names: DataFrame, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """CALL edges from calls of RPCs (name, or its lower-case-first form) to methods of that name with parameters, and the
    names that too many methods have, which are not linked."""
    wanted = names.select("name", F.explode(F.array_distinct(F.array("name", fn.lc_first(F.col("name"))))).alias("called"))
    with_params = graph.parameters().select(F.col("method").alias("id")).distinct()
    impl = graph.methods().join(with_params, "id", "left_semi").select(F.col("id").alias("dst"), "name")
    count = impl.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    calls = graph.calls().join(graph.e("CALL").select(F.col("src").alias("id")), "id", "left_anti").select(F.col("id").alias("src"), F.col("name").alias("called"))
    good = count.where(F.col("n") <= most).select("name")
    edges = calls.join(wanted, "called").join(good, "name").join(impl, "name").select("src", "dst", F.lit("CALL").alias("kind"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("property"))
    return edges, names.join(count.where(F.col("n") > most), "name").select("name", "n")


# inventories


def external_apis(graph: Graph, examples: int = 3) -> DataFrame:
    """(name, n, arities, spellings, examples) of calls to names that no method has; most frequent first when sorted by n."""
    defined = graph.methods().select("name").distinct()
    arity = graph.e("ARGUMENT").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("arity"))
    calls = graph.calls().where(~fn.is_operator(F.col("name"))).join(defined, "name", "left_anti").join(arity, "id", "left").withColumn("arity", F.coalesce("arity", F.lit(0)))
    some = calls.select("name", "id").withColumn("_r", F.row_number().over(W.partitionBy("name", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).where(F.col("_r") <= examples)
    some = some.withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy("id"))).where(F.col("_r") <= examples).groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("examples"))
    groups = calls.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("arity")).alias("arities"), F.sort_array(F.collect_set(fn.qualified_spelling(F.col("code")))).alias("spellings"))
    return groups.join(some, "name", "left")


def coverage(graph: Graph, specs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """How many calls are resolved, and the specs (role, spec) that name nothing in the graph."""
    done = graph.e("CALL").select(F.col("src").alias("id")).distinct().withColumn("_r", F.lit(1))
    share = graph.calls().where(~fn.is_operator(F.col("name"))).join(done, "id", "left").agg(F.count(F.lit(1)).alias("calls"), F.count("_r").alias("resolved"))
    share = share.withColumn("unresolved_pct", F.round(F.try_divide((F.col("calls") - F.col("resolved")) * 100.0, F.col("calls")), 4))
    table = graph.nodes.sparkSession.createDataFrame(specs, "role string, spec string").withColumn("name", fn.spec_name(F.col("spec")))
    return share, table.join(graph.of_kind("CALL", "METHOD").select("name").distinct(), "name", "left_anti").select("role", "spec")
