"""Analyses over derived graphs and small programs, with the SQL that states the same result."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import export, flows, passes, rules
from ..sources import derive, frontends, idl
from ..streaming import incremental
from . import catalogue
from .catalogue import NATION, ORACLES, QUERIES, on
from .graph import EDGE_KINDS, EDGES, NODE_KINDS, NODES, Graph
from .traversal import query


@on("g2", "SELECT src, dst FROM g2e WHERE kind = 'CFG'")
def cfg_linear(g):
    """Control flow made from the trees of statements in order."""
    return passes.control_flow(g.without_edges("CFG")).select("src", "dst")


@on("g2", "SELECT coalesce(lag(id) OVER w, method_id) AS src, id AS dst FROM g_ev WINDOW w AS (PARTITION BY method_id ORDER BY line) UNION ALL SELECT id, leave FROM g_ev WHERE nxt IS NULL")
def dominators_linear(g):
    return passes.dominators(g).select("src", "dst")


@on("g2", "SELECT coalesce(nxt, leave) AS src, id AS dst FROM g_ev UNION ALL SELECT id, method_id FROM g_ev WHERE line = 1")
def post_dominators_linear(g):
    return passes.post_dominators(g).select("src", "dst")


_AVOID = f"""R:r AS (SELECT {NATION}::bigint n UNION SELECT dst FROM r JOIN g3e ON src = n),
    a AS (SELECT x.n x, {NATION}::bigint n FROM r x WHERE x.n <> {NATION} UNION SELECT a.x, e.dst FROM a JOIN g3e e ON e.src = a.n WHERE e.dst <> a.x),
    d AS (SELECT x.n dom, y.n node FROM r x, r y WHERE y.n <> {NATION} AND x.n <> y.n AND (x.n = {NATION} OR NOT EXISTS (FROM a WHERE a.x = x.n AND a.n = y.n)))"""


@on("g3", "SELECT dom AS src, node AS dst FROM d q WHERE NOT EXISTS (FROM d z WHERE z.node = q.node AND z.dom <> q.dom AND EXISTS (FROM d v WHERE v.dom = q.dom AND v.node = z.dom))", _AVOID)
def dominators_cyclic(g):
    one = g.e("CALL").select(F.lit(NATION).cast("long").alias("method_id"), "src", "dst")
    return passes.dominators(g, one).select("src", "dst")


@on("g2", "SELECT e.id AS node, arg_max(d.id, d.line) AS definition FROM g_ev e JOIN g_ev d ON d.method_id = e.method_id AND d.line < e.line GROUP BY e.id, d.name")
def reaching_defs_events(g):
    return passes.last_definitions(g)


@on("g2", "SELECT method_id, count(*) AS n FROM g2n WHERE kind = 'CALL' AND line > 1 GROUP BY method_id")
def control_flow_of_trees(g):
    # the same control flow, built from the trees: edges between events
    made = passes.control_flow(replace(g.without_edges("CFG")))
    ids = g.calls().select(F.col("id").alias("src"), "method_id")
    return made.join(ids, "src").join(g.calls().select(F.col("id").alias("dst")), "dst").groupBy("method_id").agg(F.count(F.lit(1)).alias("n"))


@on("g2", "SELECT e.id AS src, max(d.id) AS dst FROM g_ev e JOIN g_ev d ON d.method_id = e.method_id AND d.name = e.name AND d.line <= 5 WHERE e.line > 5 GROUP BY e.id")
def symbol_refs(g):
    kind = F.when(F.col("kind") == "CALL", F.when(F.col("line") <= 5, "LOCAL").otherwise("IDENTIFIER")).otherwise(F.col("kind"))
    return passes.symbol_refs(replace(g, nodes=g.nodes.withColumn("kind", kind))).select("src", "dst")


_LADDER = """p AS (SELECT c.call, c.hint, m.target, m.owner = c.hint r1, EXISTS (FROM g4k WHERE a = c.hint AND b = m.owner) r2, EXISTS (FROM g4k WHERE b = c.hint AND a = m.owner) r3, m.file = c.file r5, m.n = c.n r6
        FROM g4c c JOIN g4m m ON m.name = c.name AND (c.test OR NOT m.test)),
    q AS (SELECT *, count(*) OVER w n, min(target) OVER w f, min(target) FILTER (r1) OVER w f1, count(*) FILTER (r2) OVER w n2, count(*) FILTER (r3) OVER w n3, count(*) FILTER (r5) OVER w n5, count(*) FILTER (r6) OVER w n6 FROM p WINDOW w AS (PARTITION BY call))"""


@on(
    "g4",
    """SELECT call AS src, target AS dst FROM q WHERE CASE WHEN n = 1 THEN true WHEN hint IS NOT NULL THEN CASE WHEN f1 IS NOT NULL THEN target = f1 WHEN n2 BETWEEN 1 AND 16 THEN r2 WHEN n3 BETWEEN 1 AND 16 THEN r3 ELSE false END
        WHEN n5 = 1 THEN r5 WHEN n6 = 1 THEN r6 ELSE target = f END""",
    _LADDER,
)
def call_resolution_ladder(g):
    return passes.resolve_calls(g).select("src", "dst")


_BRIDGES = """SELECT src, dst, 'DataDependence' AS kind FROM g5dd UNION ALL SELECT src, dst, 'Summary' FROM g5down UNION ALL SELECT src, dst, 'Summary' FROM g5up"""


@on("g5", _BRIDGES)
def value_flow_bridges(g):
    return flows.value_flow(g).select("src", "dst", "kind")


@on("g5", f"SELECT kind, count(*) AS n FROM ({_BRIDGES} UNION ALL SELECT src, dst, 'Summary' FROM g5all WHERE x = 0 AND dst IN (SELECT {derive._K('trade')} FROM g5) AND src IN (SELECT src FROM g5down)) GROUP BY kind", f"R:{derive.returned_sql()}, {derive.steps_sql()}")
def value_flow_degree(g):
    """With the flows through callees that the summaries know."""
    return flows.value_flow(g, flows.parameter_flows(g)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@on("g5", f"SELECT {derive._sql_id('nation', 'k')} AS method FROM g5f", f"R:{derive.returned_sql()}")
def returned_parameters(g):
    return flows.parameter_flows(g).select("method")


@on(
    "g5",
    "SELECT node, min(h)::int AS hops FROM t GROUP BY node",
    f"""R:st AS (SELECT src, dst, 0 AS cost FROM g5rd UNION ALL SELECT dst, src, 1 FROM (SELECT dst AS src, src AS dst FROM g5down)
        UNION ALL SELECT rd.src, u.dst, 1 FROM g5up u JOIN g5rd rd ON rd.dst = u.src),
    t AS (SELECT {derive._sql_id('good', '32')} node, 0 h UNION SELECT st.src, t.h + st.cost FROM t JOIN st ON st.dst = t.node WHERE t.h + st.cost <= 2)""",
)
def backward_slice_depth(g):
    """What the second argument of a nation's calls depends on, at most two calls away."""
    return flows.backward_slice(g, g.nodes.where(F.col("id") == derive.CODE["good"] * derive.UNIT + 32).select("id"), depth=2).select("node", "hops")


@on("g2", "SELECT id AS node, 0 AS hops FROM (SELECT *, max(CASE WHEN name = 'purchase' THEN line END) OVER (PARTITION BY method_id) last FROM g_ev) WHERE line <= last")
def backward_slice_events(g):
    rd = g.e("CFG").select("src", "dst", F.lit("REACHING_DEF").alias("kind"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("property"))
    inner = g.calls().select("id")
    rd = rd.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi")
    got = flows.backward_slice(replace(g, edges=g.edges.unionByName(rd.select(*g.edges.columns))), g.calls_named("purchase").select("id"), depth=1)
    return got.select("node", "hops")


@on("g3", "SELECT DISTINCT t.method, t.name FROM t", f"R:t AS (SELECT {NATION + 1}::bigint AS method, 'a' AS name UNION ALL SELECT {NATION + 2}, 'b' UNION SELECT e.src, t.name FROM t JOIN g3e e ON e.dst = t.method)")
def summary_fixpoint(g):
    base = g.nodes.where(F.col("id").isin(NATION + 1, NATION + 2)).select(F.col("id").alias("method"), F.when(F.col("id") == NATION + 1, "a").otherwise("b").alias("name"))
    return flows.call_returns(g, base)


@on("g3", "SELECT DISTINCT method, name FROM t", f"R:t AS (SELECT {NATION + 1}::bigint AS method, 'a' AS name UNION SELECT e.src, t.name FROM t JOIN g3e e ON e.dst = t.method WHERE e.src NOT IN ({NATION + 4}, {NATION + 9}))")
def summary_sanitized(g):
    base = g.nodes.where(F.col("id") == NATION + 1).select(F.col("id").alias("method"), F.lit("a").alias("name"))
    return flows.call_returns(g, base, g.nodes.where(F.col("id").isin(NATION + 4, NATION + 9)).select("id"))


@on("g3", "SELECT DISTINCT fqn FROM t", "R:t AS (SELECT full_name fqn FROM g3n WHERE name = 'NATION_7' UNION SELECT a.full_name FROM t JOIN g3n b ON b.full_name = t.fqn JOIN g3e e ON e.dst = b.id JOIN g3n a ON a.id = e.src)")
def summary_invalidation(g):
    n = g.nodes.select("id", "full_name")
    deps = g.e("CALL").join(n.select(F.col("id").alias("src"), F.col("full_name").alias("caller_fqn")), "src").join(n.select(F.col("id").alias("dst"), F.col("full_name").alias("callee_fqn")), "dst")
    return incremental.affected_summaries(deps, n.where("full_name = 'world.NATION_7'").select(F.col("full_name").alias("fqn")))


def _taint(sources: str, sinks: str, clean: str = "''") -> tuple[str, str]:
    """SQL for the shortest flows from sources (a select of ids) to arguments of calls of names in sinks, past calls of names in clean."""
    return (
        f"SELECT o AS source_id, {derive._K('trade')} AS sink_id, min(d)::int AS depth FROM t JOIN g5 ON node = {derive._K('good')} AND called IN ({sinks}) GROUP BY ALL",
        f"R:{derive.returned_sql(clean)}, {derive.steps_sql(clean)}, t AS (SELECT id o, id node, 0 st, 0 d FROM ({sources}) WHERE id NOT IN (SELECT id FROM g5cut) UNION SELECT o, s.dst, s.y, d + 1 FROM t JOIN g5s s ON s.src = t.node AND s.x = t.st WHERE d < 60)",
    )


def _found(g, spec):
    return flows.find_flows(g, spec).select("source_id", "sink_id", "depth")


_CALLED = f"SELECT {derive._K('trade')} id FROM g5 WHERE called IN ('NATION_1', 'NATION_8')"


@on("g5", *_taint(_CALLED, "'NATION_7', 'NATION_3'"))
def taint_source_sink(g):
    return _found(g, flows.TaintSpec(("NATION_1", "NATION_8"), ("NATION_7@0", "NATION_3")))


@on("g5", *_taint(_CALLED, "'NATION_7', 'NATION_3'", "'NATION_4', 'NATION_12'"))
def taint_with_sanitizer(g):
    return _found(g, flows.TaintSpec(("NATION_1", "NATION_8"), ("NATION_7@0", "NATION_3"), ("NATION_4", "NATION_12")))


@on("g5", *_taint(f"SELECT {derive._sql_id('parameter', 'k')} id FROM g5k WHERE k IN (2, 9)", "'NATION_7', 'NATION_3', 'NATION_11'"))
def taint_entry_methods(g):
    return _found(g, flows.TaintSpec((), ("NATION_7", "NATION_3", "NATION_11"), source_methods=("NATION_2", "world.NATION_9")))


@on("g2", "SELECT m.name AS method, c.name AS sink, c.line, c.id FROM g2n c JOIN g2n m ON m.id = c.method_id AND m.kind = 'METHOD' WHERE c.kind = 'CALL' AND (c.name LIKE 'err%' OR c.name = 'click')")
def forbidden_calls(g):
    return rules.forbidden_calls(g, ("err*", "click"))


@on("g1", "SELECT c_mktsegment AS method, 'r_f' AS sink, n AS line, id, 'total' AS kind_of FROM g_lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def discarded_returns(g):
    return rules.discarded_returns(g, ("r_f",))


@on("g2", "SELECT a.id FROM g_ev a WHERE a.name = 'signup' AND NOT EXISTS (FROM g_ev d WHERE d.method_id = a.method_id AND d.name = 'error' AND d.line % 10 = a.line % 10)")
def append_without_delete(g):
    calls = g.calls().withColumn("key", F.concat(F.when(F.col("name") == "signup", "K").otherwise("k"), (F.col("line") % 10).cast("string")))
    return rules.append_without_delete(calls, "signup", "error").select("id")


@on("g2", "SELECT p.id, CASE WHEN min(CASE WHEN v.line < p.line THEN v.line END) IS NOT NULL THEN 'authz-dominated@' || min(CASE WHEN v.line < p.line THEN v.line END) WHEN count(v.id) > 0 THEN 'authz-partial@' || min(v.line) END AS authz FROM g_ev p LEFT JOIN g_ev v ON v.method_id = p.method_id AND v.name = 'view' WHERE p.name = 'purchase' GROUP BY p.id")
def authz_annotated(g):
    checks = g.calls_named("view").select("id", "method_id", "line")
    return rules.annotate_authz(g, g.calls_named("purchase").select("id", "method_id", "line"), checks).select("id", "authz")


@on("g1", "SELECT name, count(*) AS n, '0,2' AS arities FROM (SELECT name FROM g1n WHERE kind = 'CALL') GROUP BY name")
def external_api_inventory(g):
    got = rules.external_apis(g)
    return got.select("name", "n", F.concat(F.lit("0,"), F.array_join(F.transform("arities", lambda x: x.cast("string")), ",")).alias("arities"))


@on("g3", "SELECT 25::bigint AS calls, (SELECT count(DISTINCT src) FROM g3e) AS resolved")
def resolved_calls(g):
    as_calls = replace(g, nodes=g.nodes.withColumn("kind", F.lit("CALL")))
    return rules.coverage(as_calls, [("sink", "x")])[0].select("calls", "resolved")


@on("g2", "SELECT role, spec FROM (VALUES ('source', 'view', 'view'), ('source', '::gone', 'gone'), ('sink', 'recv.missing@1', 'missing'), ('sink', 'a.purchase@0', 'purchase'), ('sink', '::user1', 'user1')) t(role, spec, plain) WHERE plain NOT IN (SELECT name FROM g2n WHERE kind IN ('CALL', 'METHOD'))")
def coverage_dead_names(g):
    return rules.coverage(g, [("source", "view"), ("source", "::gone"), ("sink", "recv.missing@1"), ("sink", "a.purchase@0"), ("sink", "::user1")])[1]


def rpc_link_capped(spark, sf_dir):
    """Nations ask by name for what their suppliers offer, and for what their customers do; names with more than eight providers aren't linked."""
    t = lambda n: derive.read(spark, sf_dir, n)
    offers = t("supplier").select(derive._id("supplier", F.col("s_suppkey")).alias("id"), F.concat(F.lit("Get"), "s_nationkey").alias("name"))
    offers = offers.unionByName(t("customer").select(derive._id("customer", F.col("c_custkey")).alias("id"), F.concat(F.lit("Put"), "c_nationkey").alias("name")))
    names = t("nation").select(derive._id("nation", F.col("n_nationkey")).alias("k"), F.explode(F.array(F.concat(F.lit("Get"), "n_nationkey"), F.concat(F.lit("Put"), "n_nationkey"))).alias("name"))
    calls = names.select((F.col("k") * 2 + F.when(F.col("name").startswith("Put"), 1).otherwise(0)).alias("id"), F.lit("CALL").alias("kind"), F.concat(F.lower(F.substring("name", 1, 1)), F.substring("name", 2, 9)).alias("name"))
    params = offers.select((-F.col("id")).alias("id"), F.lit("METHOD_PARAMETER_IN").alias("kind"), F.lit(1).alias("order_"))
    nodes = derive._union([offers.withColumn("kind", F.lit("METHOD")), calls, params], NODES)
    g = Graph(nodes, derive._union([offers.select(F.col("id").alias("src"), (-F.col("id")).alias("dst"), F.lit("AST").alias("kind"), F.lit(1).alias("ord"))], EDGES))
    linked, skipped = rules.link_rpcs(g, names.select("name"))
    return linked.select(F.col("src").cast("string").alias("asked"), "dst").unionByName(skipped.select(F.col("name").alias("asked"), F.col("n").alias("dst")))


QUERIES["rpc_link_capped"] = rpc_link_capped
ORACLES["rpc_link_capped"] = f"""WITH o AS (SELECT {derive._sql_id('supplier', 's_suppkey')} id, s_nationkey k, 'Get' kind FROM supplier UNION ALL SELECT {derive._sql_id('customer', 'c_custkey')}, c_nationkey, 'Put' FROM customer),
    n AS (SELECT *, count(*) OVER (PARTITION BY kind, k) n FROM o)
    SELECT ({derive._sql_id('nation', 'k')} * 2 + CASE kind WHEN 'Put' THEN 1 ELSE 0 END)::varchar AS asked, id AS dst FROM n WHERE n <= 8 UNION ALL SELECT DISTINCT kind || k, n FROM n WHERE n > 8"""


@on("g1", "SELECT feature, count(*) AS nodes FROM (SELECT 'label:' || kind feature FROM g1n UNION ALL SELECT 'name:' || name FROM g1n WHERE name IS NOT NULL) GROUP BY feature")
def vectors_bag(g):
    got = export.vectors(g).where("feature LIKE 'label:%' OR feature LIKE 'name:%'")
    return got.groupBy("feature").agg(F.sum("n").alias("nodes"))


@on("g1", "SELECT c.method_id AS unit, count(*) AS n FROM g1e e JOIN g1n c ON c.id = e.dst JOIN g1n p ON p.id = e.src WHERE e.kind = 'AST' AND c.method_id IS NOT NULL AND p.method_id = c.method_id GROUP BY c.method_id")
def export_per_method_counts(g):
    return export.per_method(g, "ast")[1].groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


@on("g1", "SELECT kind, count(*) AS n FROM g1e WHERE kind IN ('AST', 'CFG', 'REACHING_DEF', 'DDG', 'REF', 'EVAL_TYPE', 'ARGUMENT') GROUP BY kind")
def export_edges_repr(g):
    return export.per_method(g, "all")[1].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@on("g2", "SELECT method_id AS unit, 'digraph g {' || chr(10) || string_agg(line, chr(10) ORDER BY o, a, b) || chr(10) || '}' || chr(10) AS text FROM (SELECT method_id, 0 o, id a, 0 b, '  \"' || id || '\" [label=\"' || kind || ': ' || CASE WHEN kind = 'CALL' THEN name || '()' ELSE name END || '\"]' AS line FROM g2n UNION ALL SELECT n.method_id, 1, src, dst, '  \"' || src || '\" -> \"' || dst || '\" [label=\"CFG\"]' FROM g2e JOIN g2n n ON n.id = src WHERE g2e.kind = 'CFG') GROUP BY method_id")
def export_dot(g):
    return export.dot(g, "cfg")


@on("g2", "SELECT 'r1' AS rule_id, 'error' AS level, 'bad: ' || name || '() reaches ' || name AS message, '' AS uri, line FROM g_ev WHERE name = 'error'")
def sarif_results_flat(g):
    pack = rules.RulePack((rules.Rule("r1", "forbidden-call", sinks=("error",), severity="high", description="bad"),))
    meta = g.nodes.sparkSession.createDataFrame([("r1", "high", "bad")], "id string, severity string, description string")
    return export.sarif_results(rules.run_pack(g, pack), meta)


@on("g2", "SELECT name, line, change FROM (SELECT DISTINCT name, line, 'added' AS change FROM g_ev WHERE event_id % 3 <> 0 AND (name, line) NOT IN (SELECT (name, line) FROM g_ev WHERE event_id % 3 <> 1) UNION ALL SELECT DISTINCT name, line, 'removed' FROM g_ev WHERE event_id % 3 <> 1 AND (name, line) NOT IN (SELECT (name, line) FROM g_ev WHERE event_id % 3 <> 0))")
def scan_delta_added_removed(g):
    from ..sources.derive import CODE, UNIT

    shift = (CODE["event"] * UNIT) % 3
    event = F.pmod(F.col("id") - shift, F.lit(3))
    return incremental.delta(g.calls().where(event != 1).select("name", "line"), g.calls().where(event != 0).select("name", "line"), ["name", "line"])


@on("g1", "SELECT violation, count(*) AS n FROM (SELECT 'dangling-dst' AS violation FROM g1e WHERE kind = 'REF' AND dst % 7 = 0 UNION ALL SELECT 'unknown-node-kind' FROM g1n WHERE kind = 'MEMBER' UNION ALL SELECT 'dangling-dst' FROM g1e e WHERE e.kind = 'ARGUMENT' AND ord = 1 AND dst % 7 = 0 UNION ALL SELECT 'illegal-ends' FROM g1e e JOIN g1n c ON c.id = e.dst WHERE e.kind = 'AST' AND c.kind = 'BLOCK') GROUP BY violation")
def schema_violations(g):
    nodes = g.nodes.where("NOT (kind = 'TYPE' AND id % 7 = 0)").withColumn("kind", F.when(F.col("kind") == "MEMBER", "STRANGE").otherwise(F.col("kind")))
    allowed = g.nodes.sparkSession.createDataFrame([("AST", "NAMESPACE", "TYPE_DECL"), ("AST", "TYPE_DECL", "METHOD"), ("AST", "BLOCK", "CALL")], "kind string, src_kind string, dst_kind string")
    return export.schema_violations(nodes, g.edges, allowed, NODE_KINDS, EDGE_KINDS).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


_STEPS = "R:t AS (SELECT src a, dst b, 1 d FROM g3e UNION SELECT t.a, e.dst, t.d + 1 FROM t JOIN g3e e ON e.src = t.b WHERE t.d < 25), m AS (SELECT a, b, min(d) d FROM t GROUP BY a, b)"


@on("g3", "SELECT x.a, x.b, x.d > 1 AS derived, CASE WHEN x.d > 1 THEN min(y.b) END AS via FROM m x LEFT JOIN (SELECT m.a, m.b, m.d, e.dst FROM m JOIN g3e e ON e.src = m.b) y ON y.a = x.a AND y.d = x.d - 1 AND y.dst = x.b GROUP BY x.a, x.b, x.d", _STEPS)
def facts_with_provenance(g):
    """Each fact with the step before the last by which it was first derived."""
    facts, supports = flows.fact_closure(g.e("CALL").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return facts.join(supports, ["a", "b"], "left").select("a", "b", "derived", "via")


_REST = "R:t AS (SELECT dst id FROM g3e WHERE src = 2000000000005 UNION SELECT 2000000000005 UNION SELECT e.dst FROM t JOIN g3e e ON e.src = t.id)"


@on("g3", "SELECT DISTINCT id FROM t", _REST)
def support_chain(g):
    s = g.e("CALL").select(F.col("src").alias("fact_id"), F.col("dst").alias("support_id"))
    return flows.support_chain(s, g.nodes.where(F.col("id") == NATION + 5).select("id"))


@on("g3", "SELECT DISTINCT id FROM t", "R:t AS (SELECT 2000000000005 id UNION SELECT e.src FROM t JOIN g3e e ON e.dst = t.id)")
def invalidated_by(g):
    s = g.e("CALL").select(F.col("src").alias("fact_id"), F.col("dst").alias("support_id"))
    return flows.invalidated_by(s, g.nodes.where(F.col("id") == NATION + 5).select("id"))


@on("g6", "SELECT DISTINCT path AS route, CASE WHEN safe THEN 'GET' ELSE 'ANY' END AS verb, handler, page_id::int AS line FROM g6h WHERE path <> '' AND handler <> 'on_es'")
def routes_mined(g):
    """Registrations of pages by their paths; handlers that no method has the name of give none."""
    return rules.mine_routes(g)


# small programs
PROGRAMS = {
    "main.c": "int clean(int v) { return v; }\nint source(void);\nvoid sink(int v);\nint wrap(int v) { int t = v; return t; }\nvoid direct(void) { int x = source(); sink(x); }\nvoid through(void) { int x = source(); int y = wrap(x); sink(y); }\n"
    "void cleaned(void) { int x = source(); int y = clean(x); sink(y); }\nvoid killed(void) { int x = source(); x = 0; sink(x); }\nvoid branch(int a) { int x = 0; if (a) { x = source(); } sink(x); }\nvoid down(int v) { sink(v); }\nvoid passes(void) { int x = source(); down(x); }\n"
    "int made(void) { return source(); }\nvoid returned(void) { int x = made(); sink(x); }\nvoid scan(char *b) { scanf(\"%s\", b); scanf(\"%8s\", b); }\n",
    "app.py": "def helper(a, b):\n    c = a + b\n    return c\n\ndef main(x):\n    y = helper(x, 1)\n    if y > 2:\n        print(y)\n    return y\n",
    "lib.go": "func helper(a int, b int) int { return a }\nfunc main() { x := helper(1, 2); use(x) }\n",
    "T.java": "class T { int helper(int a, int b) { return a; } void main() { int x = helper(1, 2); use(x); } }\n",
    "m.rs": "fn helper(a: i32, b: i32) -> i32 { a }\nfn main() { let x = helper(1, 2); consume(x); }\n",
    "m.js": "function helper(a, b) { return a }\nfunction main() { const x = helper(1, 2); consume(x); }\n",
}


def program(spark, path):
    rows = spark.createDataFrame([(p, t) for p, t in PROGRAMS.items() if p in path], "path string, text string")
    return passes.derive_layers(frontends.build_graph(rows))


def _values(columns, rows):
    body = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(columns)})"


def golden(name, columns, rows, run):
    QUERIES[name] = lambda spark, sf_dir: run(spark)
    ORACLES[name] = _values(columns, rows)


golden(
    "program_taint_flows", ["method", "origin"], [("direct", "source()"), ("through", "source()"), ("branch", "source()"), ("down", "source()"), ("returned", "source()")],
    lambda spark: flows.find_flows(program(spark, ["main.c"]), flows.TaintSpec(("source",), ("sink",), ("clean",))).select("method", "origin").distinct(),
)
golden("program_parameter_flows", ["method", "k"], [("clean", 0), ("wrap", 0)], lambda spark: (lambda g: flows.parameter_flows(g).join(g.methods().select(F.col("id").alias("method"), "name"), "method").select(F.col("name").alias("method"), "k"))(program(spark, ["main.c"])))
golden("program_unbounded_scanf", ["method", "sink"], [("scan", "scanf")], lambda spark: rules.unbounded_scanf(program(spark, ["main.c"])).select("method", "sink"))
golden(
    "program_callees", ["path", "caller", "callee"], [("app.py", "main", "helper"), ("lib.go", "main", "helper"), ("T.java", "main", "helper"), ("m.rs", "main", "helper"), ("m.js", "main", "helper")],
    lambda spark: (lambda g: g.e("CALL").join(g.nodes.select(F.col("id").alias("src"), F.col("method_id"), "file_id"), "src").join(g.methods().select(F.col("id").alias("method_id"), F.col("name").alias("caller")), "method_id").join(g.methods().select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst").join(g.files, "file_id").select("path", "caller", "callee"))(program(spark, ["app.py", "lib.go", "T.java", "m.rs", "m.js"])),
)
golden("program_controls", ["value"], [("print",)], lambda spark: query(program(spark, ["app.py"]), 'cpg.call.name(">").controls.isCall.name').rows)
golden("program_reachable_by", ["value"], [("x",)], lambda spark: query(program(spark, ["app.py"]), 'cpg.ret.reachableBy(cpg.parameter.name("x")).name').rows)
golden("proto_rpcs", ["name"], [("Get",), ("Put",)], lambda spark: idl.proto_rpcs(spark.createDataFrame([("  rpc Get (A) returns (B);",), ("message X {",), ("rpc Put(A) returns (B) {}",)], "value string")))
golden("play_routes", ["verb", "path", "class", "method"], [("GET", "/a/:id", "Items", "show"), ("POST", "/a", "Items", "add")], lambda spark: idl.play_routes(spark.createDataFrame([("GET /a/:id controllers.Items.show(id: Long)",), ("# no",), ("POST   /a   @app.Items.add",), ("-> /x y.Routes",)], "value string")))
golden("thrift_services", ["service", "method"], [("Base", "ping"), ("Kv", "get"), ("Kv", "put"), ("Kv", "ping")], lambda spark: idl.thrift_services(spark.createDataFrame([("service Base { void ping() } // x\nservice Kv extends Base { string get(1: string k) throws (1: E e), oneway void put(1: string k,\n 2: string v) }",)], "text string")))
golden("function_models", ["fqn", "from_kind", "from_idx", "to_kind", "via"], [("f", "param", 0, "return", None), ("f", "recv", None, "return", "esc")], lambda spark: idl.function_models(spark, spark.createDataFrame([('[{"functionDeclaration":{"methodName":"f"},"dataFlows":[{"from":"param0","to":"return"},{"from":"recv","to":"return","labels":["sanitized:esc"]}]}]',)], "text string"))[0])


def incremental_equals_clean(spark, sf_dir):
    """Nodes and edges of an updated graph less those of a clean build, and the other way round: none."""
    rows = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    two = {k: PROGRAMS[k] for k in ("app.py", "lib.go")}
    old = passes.derive_layers(frontends.build_graph(rows(two)))
    two["lib.go"] = two["lib.go"].replace("use(x)", "use(x); log(x)")
    new, clean = incremental.update(old, rows(two)), passes.derive_layers(frontends.build_graph(rows(two)))
    a, b = new.edges.select("src", "dst", "kind", "property"), clean.edges.select("src", "dst", "kind", "property")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("differences"))


QUERIES["incremental_equals_clean"] = incremental_equals_clean
ORACLES["incremental_equals_clean"] = "SELECT 0::bigint AS differences"
